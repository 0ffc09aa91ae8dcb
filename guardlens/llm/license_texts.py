"""License notices.

Fixed values: texts as their stewards publish them, without the lines that name a holder and a year. Paragraphs that several
licenses share are written once.
"""

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software."""

_AUTHOR_DISCLAIMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_NO_ENDORSEMENT = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

_HOPE = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"""

_WITHOUT_CONDITIONS = """distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def _gnu(what: str, license: str, versions: str, mark: str) -> str:
    return (f"{what} is free software{mark} you can redistribute it and/or modify it under the terms of the {license} as published by the Free "
            f"Software Foundation{versions}. {what} {_HOPE} {license} for more details. You should have received a copy of the {license} along "
            f"with {what[0].lower() + what[1:]}. If not, see <https://www.gnu.org/licenses/>.")


def _creative_commons(kind: str) -> str:
    return f"This work is licensed under a Creative Commons {kind} 4.0 International License."


TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "mit": f"{_PERMISSION} {_AS_IS}",
    "mit-0": f"{_PERMISSION.split(', subject to')[0]}. {_AS_IS}",
    "json": f"{_PERMISSION} The Software shall be used for Good, not Evil. {_AS_IS}",
    "x11": f"""{_PERMISSION} {_AS_IS} Except as contained in this notice, the name of the copyright holders shall not be used in advertising
or otherwise to promote the sale, use or other dealings in this Software without prior written authorization.""",
    "isc": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. {_AUTHOR_DISCLAIMS}""",
    "0bsd": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. {_AUTHOR_DISCLAIMS}""",
    "bsd-2-clause": f"{_REDISTRIBUTION} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_REDISTRIBUTION} 3. {_NO_ENDORSEMENT} {_BSD_DISCLAIMER}",
    "bsd-4-clause": f"""{_REDISTRIBUTION} 3. All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the organization. 4. {_NO_ENDORSEMENT} {_BSD_DISCLAIMER}""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in
a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions
must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
altered from any source distribution.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license
grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all
derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO
EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "unlicense": f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large
and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law. {_AS_IS.split(" OR COPYRIGHT")[0]} BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>""",
    "wtfpl": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004. Everyone is permitted to copy and distribute
verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK
YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "postgresql": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee,
and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following
two paragraphs appear in all copies.""",
    "apache-2.0-notice": f"""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is {_WITHOUT_CONDITIONS}
See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-2.0-only-notice": _gnu("This program", "GNU General Public License", "; version 2", ";"),
    "gpl-2.0-notice": _gnu("This program", "GNU General Public License", "; either version 2 of the License, or (at your option) any later version", ";"),
    "gpl-3.0-notice": _gnu("This program", "GNU General Public License", ", either version 3 of the License, or (at your option) any later version", ":"),
    "lgpl-2.1-notice": _gnu("This library", "GNU Lesser General Public License", "; either version 2.1 of the License, or (at your option) any later version", ";"),
    "lgpl-3.0-notice": _gnu("This program", "GNU Lesser General Public License", ", either version 3 of the License, or (at your option) any later version", ":"),
    "agpl-3.0-notice": _gnu("This program", "GNU Affero General Public License", ", either version 3 of the License, or (at your option) any later version", ":"),
    "gfdl-1.3-notice": """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free
Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no
Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled "GNU Free Documentation License".""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "epl-2.0-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "cddl-1.0-notice": """The contents of this file are subject to the terms of the Common Development and Distribution License (the
"License"). You may not use this file except in compliance with the License.""",
    "eupl-1.2-notice": f"""Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent
versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence. You may obtain a copy of the
Licence at: https://joinup.ec.europa.eu/software/page/eupl Unless required by applicable law or agreed to in writing, software
distributed under the Licence is {_WITHOUT_CONDITIONS} See the Licence
for the specific language governing permissions and limitations under the Licence.""",
    "ofl-1.1-notice": """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ
at: https://openfontlicense.org""",
    "perl": "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
    "cc0-1.0-notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to
this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of
the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.""",
    "cc-by-4.0": _creative_commons("Attribution"),
    "cc-by-sa-4.0": _creative_commons("Attribution-ShareAlike"),
    "cc-by-nd-4.0": _creative_commons("Attribution-NoDerivatives"),
    "cc-by-nc-4.0": _creative_commons("Attribution-NonCommercial"),
    "cc-by-nc-sa-4.0": _creative_commons("Attribution-NonCommercial-ShareAlike"),
    "cc-by-nc-nd-4.0": _creative_commons("Attribution-NonCommercial-NoDerivatives"),
}
