"""Operators against brute force on a fixture of awkward rows."""

import io
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_rows import prose
from guardlens.llm import (chat_roles, decontaminate, hpyp, jaccard_join, license_scan, mixing, quality, queries, text, token_ids,
                           url_filter, wordpiece)

SPACE = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_word_hashes_follow_the_words():
    t = (prose(9, 500) + " \x00 É é A a\x1cb").encode()
    for mask, pattern, fold in ((text.BY_SPACE, SPACE, True), (text.BY_ALNUM, ALNUM, True), (text.BY_SPACE, SPACE, False)):
        want = pattern.findall(low(t.decode()) if fold else t.decode())
        for segment in (64, 1 << 17):
            old, text.SEGMENT = text.SEGMENT, segment
            s, e, h = text.hash_words(np.frombuffer(t, np.uint8), mask, fold)
            text.SEGMENT = old
            got = [t[a:b].decode() for a, b in zip(s, e)]
            assert (low(" ".join(got)).split(" ") if fold else got) == want
            by_hash = {}
            for w, x in zip(want, h.tolist()):
                assert by_hash.setdefault(x, w) == w
            assert len(by_hash) == len(set(want))


def test_quality_base_figures_and_verdict(docs, rows, empty):
    got = sorted((tuple(r)[:7] + (r.kept,) for r in quality.judged(docs).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w, places = SPACE.findall(t), {}
        for k in range(len(w) - 2):
            places.setdefault(tuple(w[k:k + 3]), []).append(k)
        rep = len({k + j for v in places.values() if len(v) > 1 for k in v for j in range(3)})
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        bad = len(w) < 50 or 100 * rep > 50 * len(w)
        seen, lost = set(), 0
        for x in lines:
            lost += len(SPACE.findall(x)) if quality.line_fails(x.encode(), len(SPACE.findall(x)), x in seen, quality.Rules()) else 0
            seen.add(x)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, bad,
                     not bad and 100 * lost <= 50 * len(w)))
    assert got == sorted(want, key=str)
    assert quality.judged(empty).count() == 0


def test_quality_lines_and_kept_documents(spark, docs):
    r = quality.Rules()
    assert quality.line_fails(b"Home | News | Sport | Mail", 4, False, r) == "navigation"
    assert quality.line_fails(b"Read on", 2, False, r) == "navigation"
    assert quality.line_fails(b"All rights reserved by us.", 5, False, r) == "boilerplate"
    assert quality.line_fails(b"a### b$$$ c%%% d&&& e.", 5, False, r) == "punctuation"
    assert quality.line_fails(b"A plain sentence of words.", 5, False, r) == ""
    assert quality.line_fails(b"A plain sentence of words.", 5, True, r) == "boilerplate"
    for line in ("Alle Rechte vorbehalten bei uns.", "TOUS DROITS RÉSERVÉS, PARIS.", "Política de privacidad y AVISO LEGAL.", "Haz clic aquí para ver.",
                 "Read more about it at http://x.org today.", "if (x) { return y; } else z."):
        assert quality.line_fails(line.encode(), len(line.split()), False, r) == "boilerplate", line
    long = prose(9, 120).replace("\n", " ")
    for phrase in ("We use a cookie here.", "Read more.", "Weiterlesen.", "En savoir plus.", "A set {a, b} is meant.", "One | two | three | four."):
        line = f"{long}. {phrase} {long}."
        assert quality.line_fails(line.encode(), len(line.split()), False, r) == "", phrase
        only = " ".join([phrase] * 3)
        assert quality.line_fails(only.encode(), len(only.split()), False, r) in ("boilerplate", "navigation"), phrase
    assert quality.boilerplate_words("它很好。Cookie 说明。好 的".encode()) == 2
    assert quality.boilerplate_words(b"") == 0 and quality.boilerplate_words(b"\xff { \xfe") == 3
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.where("text is null").isEmpty()
    one = spark.createDataFrame([(1, prose(8, 90) + "\nAll rights reserved.", 7)], "doc_id long, text string, n_chars long")
    out = quality.kept_documents(one).first()
    assert out.text == prose(8, 90) and out.n_chars == len(out.text)


def _links(rows):
    sets = []
    for _, t, *_ in rows:
        w = SPACE.findall(low(t))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = part[i], part[j]
                part = [y if p == x else p for p in part]
    least = {}
    for k, (r, s) in enumerate(zip(rows, sets)):
        if s and r[0] is not None:
            least[part[k]] = min(least.get(part[k], r[0]), r[0])
    return sorted(((r[0], len(s), least.get(part[k]) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("bounds", [{}, {"region_sets": 2, "region_shingles": 100}])
def test_jaccard_components(spark, rows, bounds):
    more = list(rows)
    body = prose(20, 200).split(" ")
    for k in range(60):  # a chain of near copies, a group around one text, a frequent line
        w = list(body)
        for j in range(k % 12):
            w[(11 * j + k) % len(w)] = f"new{j}"
        more.append((100 + k, " ".join(w), None, k))
        more.append((200 + k, "one line that every text of this group has in its first place. " + prose(300 + k, 40), None, k))
    df = spark.createDataFrame([r[:2] for r in more], "doc_id long, text string").repartition(5)
    got = sorted((tuple(r)[:3] for r in jaccard_join.classes(df, **bounds).collect()), key=str)
    assert got == _links(more)


def test_jaccard_one_of_each(docs, rows, empty):
    stay = jaccard_join.one_of_each(docs)
    assert stay.columns == docs.columns
    want = {i for i, _, c in _links(rows) if i is not None and i == c}
    assert sorted(r.doc_id for r in stay.where("doc_id is not null").collect()) == sorted(want)
    assert stay.where("doc_id is null").count() == 2
    assert jaccard_join.classes(empty).count() == 0


def test_cells_agree_with_all_pairs():
    r = np.random.default_rng(3)
    for _ in range(30):
        base = r.integers(0, 2 ** 63, 60).astype(np.uint64)
        sets = [np.unique(np.where(r.random(60) < r.choice([0, .05, .15]), r.integers(0, 2 ** 63, 60), base).astype(np.uint64)) for _ in range(12)]
        e = r.permutation(1000)[:12]
        part = list(range(12))
        for i in range(12):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                    x = part[i]
                    part = [part[j] if p == x else p for p in part]
        got = dict(jaccard_join.link_cell(e, np.array([len(s) for s in sets]), [s.tobytes() for s in sets]))
        for i in range(12):
            assert got.get(int(e[i]), int(e[i])) == min(int(e[k]) for k in range(12) if part[k] == part[i])


def test_decontamination(spark, rows, docs, empty):
    w = ALNUM.findall(low(rows[0][1]))
    long = ALNUM.findall(low(rows[11][1]))
    items = [(1, " ".join(w[20:35])), (2, "two words"), (3, None), (4, " ".join(long[500:512]).upper()), (5, " ".join(w[40:52])), (2, "two words"),
             (6, "never seen anywhere in these texts at all by anyone"), (7, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        x = ALNUM.findall(low(t))
        m = min(10, len(x))
        for p in range(len(x) - m + 1 if m else 0):
            windows.setdefault(tuple(x[p:p + m]), set()).add(i)
    want = []
    for i, t, *_ in rows:
        x, hit, found = ALNUM.findall(low(t)), set(), set()
        for m in {len(k) for k in windows}:
            for p in range(len(x) - m + 1):
                if tuple(x[p:p + m]) in windows:
                    hit |= set(range(p, p + m))
                    found |= windows[tuple(x[p:p + m])]
        want.append((i, len(x), len(hit), len(found)))
    found = decontaminate.decontaminate(docs, bench)
    assert sorted((tuple(r) for r in decontaminate.digests(found, "doc_id").select("doc_id", "n_words", "n_hit", "n_items").collect()), key=str) == sorted(want, key=str)
    bad = {i for i, _, h, _ in want if h}
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in bad), key=str)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_mixing_near_targets(spark, docs, rows, empty):
    many = spark.createDataFrame([(i, "w " * (1 + i % 37), "abc"[0 if i % 3 else i % 2 + 1]) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix_report(many).collect()
    by = {}
    for r, s in zip(sorted(got, key=lambda r: r.doc_id), ["abc"[0 if i % 3 else i % 2 + 1] for i in range(3000)]):
        assert r.taken in (0, r.size, 2 * r.size)
        x = by.setdefault(s, [r.source_size, r.target, 0])
        x[2] += r.taken
    total = sum(x[0] for x in by.values())
    assert sum(x[1] for x in by.values()) == pytest.approx(1.5 * total)
    for size, target, taken in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 37
    again = {(r.doc_id, r.taken) for r in mixing.mix_report(many.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    # a smaller budget takes a subset
    less = {r.doc_id: r.taken for r in mixing.mix_report(many, budget=0.7).collect()}
    assert all(less[r.doc_id] <= r.taken for r in got)
    out = mixing.mix_documents(docs)
    report = {(r.doc_id, r.size): r.copies for r in mixing.mix_report(docs).collect()}
    assert out.columns == docs.columns and out.count() == sum(report[i, len(SPACE.findall(t or ""))] for i, t, *_ in rows)
    assert mixing.mix_report(empty).count() == 0


def test_token_files_round_trip(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = token_ids.round_trip(docs.repartition(3), path, block_ids=300, file_bytes=2000).collect()
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, xs in ids.items() for x in xs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_ids.round_trip(empty, path).count() == 0


def test_packing_every_width():
    v = np.array([0, 1, 255, 256, 65535, 65536, 2 ** 24 - 1, 2 ** 24, 2 ** 32 - 1] * 5 + [7], np.uint32)
    control, data = token_ids.pack(v)
    assert (token_ids.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(v)) == v).all()
    with pytest.raises(ValueError):
        list(token_ids.blocks(io.BytesIO(b"x" * 50), np.zeros(1, np.uint32)))


def test_encoder_on_odd_white_space():
    import random

    from tokenizers import Tokenizer

    path, r = queries.tokenizer_file("byte_bpe_50k.json"), random.Random(4)
    tok, enc = Tokenizer.from_file(path), token_ids.Encoder(path, cache=30)
    pieces = ["a", "B", " ", "\n", "\t", "  ", "é", "1", ".", ",", "<|endoftext|>", "'s", "\r", "\u00a0", "日本", "\n\n", "\x1f"]
    for _ in range(700):
        texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 5))]
        ids, lengths = enc.encode(texts)
        want = [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, []), texts
        assert len(enc.words) <= 60


def test_wordpiece_counts(docs, rows, empty):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    vocabulary = set(wordpiece.byte_vocabulary(path))
    longest = max(map(len, vocabulary))

    def greedy(w):
        n = i = 0
        while i < len(w):
            j = next((j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in vocabulary), None)
            if j is None:
                return 0
            i, n = j, n + 1
        return n

    memo, want = {}, []
    for i, t, *_ in rows:
        w = SPACE.findall(t or "")
        for x in w:
            memo.setdefault(x, greedy(b" " + x.encode()))
        want.append((i, len(w), sum(memo[x] or 1 for x in w), sum(not memo[x] for x in w)))
    assert sorted((tuple(r) for r in wordpiece.token_counts(docs, path).collect()), key=str) == sorted(want, key=str)
    assert wordpiece.token_counts(empty, path).count() == 0
    a = wordpiece.Automaton([b"ab", b"abcd", b"c", b"bx"])
    assert [a.length(x) for x in (b"abc", b"abcd", b"abcx", b"", b"z", b"abbx")] == [2, 1, 0, 0, 0, 2]


def test_licenses(spark, docs, empty):
    mit = license_scan.TEMPLATES["mit"].split()
    broken = mit[:30] + ["CHANGED"] * 4 + mit[36:]
    far = []
    for w in mit:
        far += [w] + ["filler"] * 5
    df = spark.createDataFrame([(1, "x " * 30 + " ".join(broken) + " y" * 30), (2, "Released under the MIT License."), (3, " ".join(far)), (4, None),
                                (5, " ".join(mit[:40])), (6, " ".join(mit).upper() + " " + " ".join(mit))], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert got[1].license == "mit" and got[1].matched == got[1].template_words - 6 and got[1].start_word == 30
    assert got[2].license == "mit-notice" and got[2].coverage == 1.0
    assert [got[k].license for k in (3, 4, 5)] == [None] * 3
    assert got[6].license == "mit"
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).where("license is not null").count() == 0


def test_alignment_is_at_most_the_longest_common_subsequence():
    r = np.random.default_rng(5)

    def lcs(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        return int(t[-1, -1])

    for _ in range(200):
        a, b = (r.integers(0, 12, r.integers(0, 25)).tolist() for _ in range(2))
        for pairs in (license_scan.lcs_pairs(a, b), license_scan.align(a, b)):
            assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
            assert len(pairs) <= lcs(a, b) and bool(pairs) == (lcs(a, b) > 0)
        assert len(license_scan.lcs_pairs(a, b)) == lcs(a, b)
        assert len(license_scan.align(a, a)) == len(a)
        chain = license_scan.anchors(a, b)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:]))


def test_urls(spark):
    urls = [(1, "http://a.net/x"), (2, "https://EXAMPLE.net/en/x?q#f"), (3, "http://b.example.com/de/"), (4, "http://c.org/fr/1"), (5, None), (6, "no scheme"),
            (7, "http://example.net/de/?x=/en/"), (8, "http://notnet/x"), (9, "http://a.net"), (10, "http://h.example.com/en/"), (11, "ftp://u?x://y"), (4, "http://c.org/fr/1")]
    pages = spark.createDataFrame([(i, u, "the cat sat on the mat cat mat " * 5 if i else None, 1) for i, u in urls], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in url_filter.judged(pages).collect()}
    assert {k: (r.host, r.path, r.rule) for k, r in got.items()} == {
        1: ("a.net", "/x", "net/"), 2: ("example.net", "/en/x", "example.net/en/"), 3: ("b.example.com", "/de/", "example.com/de/"),
        4: ("c.org", "/fr/1", "org/fr/"), 5: ("", "", None), 6: ("", "", None), 7: ("example.net", "/de/", "net/"), 8: ("notnet", "/x", None),
        9: ("a.net", "", None), 10: ("h.example.com", "/en/", None), 11: ("u", "", None)}
    assert [got[k].verdict for k in (1, 2, 3, 4, 7)] == ["block", "allow", "block", "allow", "block"]
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judged(pages.limit(0)).count() == 0
    none = url_filter.judged(pages.where("page_id in (5, 6)")).collect()
    assert [r.verdict for r in none] == ["allow", "allow"]


def test_host_segmentation_is_the_best_split():
    known = {"the": 100, "cat": 20, "at": 30, "sat": 15, "he": 10, "mat": 9, "a": 5, "t": 1}
    total, run = sum(known.values()), "thecatsat"
    at = {(a, b): known[run[a:b]] for a in range(len(run)) for b in range(a + 1, len(run) + 1) if run[a:b] in known}

    def p(words):
        return sum(math.log10(known[w] / total) if w in known else 1 - math.log10(total) - len(w) for w in words)

    def splits(s):
        return [[]] if not s else [[s[:k], *r] for k in range(1, len(s) + 1) for r in splits(s[k:])]

    best = max(map(p, splits(run)))
    assert p(url_filter.best_split(run, at, total)) == pytest.approx(best)
    assert url_filter.best_split(run, at, total) == ["the", "cat", "sat"]


def test_pitman_yor_scores(docs, rows, empty):
    got = hpyp.scores(docs, frequent=20, common=40).collect()
    toks = [(i, [*SPACE.findall(low(t)), None]) for i, t, *_ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, x in toks if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in x), 5)) for i, x in toks), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == want
    assert all(r.score < 0 for r in got)
    again = hpyp.scores(docs.repartition(5), frequent=20, common=40).collect()
    assert sum(r.score for r in again) == pytest.approx(sum(r.score for r in got))
    assert hpyp.scores(empty).count() == 0
    assert hpyp.perplexity(hpyp.scores(docs, frequent=20, common=40)).count() == len({r.held_out for r in got})


def test_probabilities_sum_to_one(spark, docs):
    src = docs.select(docs.doc_id.alias("id"), "text")
    counts = hpyp.word_counts(src)
    top = counts.orderBy("n", ascending=False).limit(15).toArrow().column("h").to_numpy().view(np.uint64)
    words = hpyp.Words(np.sort(top[top != hpyp.END]))
    weight, root, pair, direct = hpyp.gibbs(hpyp.pair_counts(src, spark.sparkContext.broadcast(words)), words)
    assert np.allclose(root.sum(axis=1), 1)
    for u in range(words.dishes):
        own = direct[(pair >= u * words.dishes) & (pair < (u + 1) * words.dishes)].sum()
        assert np.mean(weight[:, u]) + own == pytest.approx(1, abs=1e-5)
    rare, unknown = hpyp.rare_words(counts, words.frequent)
    assert sum(r.p for r in rare.collect()) + unknown == pytest.approx(1)


def test_table_draws_have_the_right_law():
    # three customers by the sequential seating rule, against draws from the collapsed weights
    d, a, base = 0.5, 1.0, 0.3
    s = {1: 1.0}
    for c in range(1, 3):
        nxt = {}
        for t, p in s.items():
            stay, new = c - d * t, (a + d * t) * base
            nxt[t] = nxt.get(t, 0) + p * stay
            nxt[t + 1] = nxt.get(t + 1, 0) + p * new
        s = nxt
    total = sum(s.values())
    n = 40000
    t = hpyp.draw_tables(np.full(n, 3), np.full(n, base), np.zeros(n), d, a, np.arange(n, dtype=np.uint64), 1)
    for k, p in s.items():
        assert (t == k).mean() == pytest.approx(p / total, abs=0.02)
    big = hpyp.draw_tables(np.array([1, 2, 100, 10 ** 6]), np.full(4, 1e-3), np.zeros(4), .8, 1.0, np.arange(4, dtype=np.uint64), 1)
    assert big[0] == 1 and (big >= 1).all() and (big <= [1, 2, 100, 10 ** 6]).all()


def test_chat_roles(spark):
    conv = []
    for c in range(40):
        for t in range(6 if c else 700):
            role = "user" if t % 2 == 0 else "assistant"
            conv.append((c, t, role, f"What is {t}?" if role == "user" else prose(c * 1000 + t, 40)))
    conv += [(100, 0, None, None), (100, 1, "tool", "x"), (None, None, "user", "Hi?"), (101, 0, "user", ""), (101, 0, "user", ""), (7, 5, "assistant", "A: text\nwith lines")]
    df = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")
    got = chat_roles.recover(df).collect()
    assert sum(r.lines_right for r in got) > 0.9 * sum(r.n_lines for r in got)
    assert {r.conv_id for r in got} == {c[0] for c in conv} and sum(r.conv_id == 0 for r in got) == 3
    assert chat_roles.recover(df.limit(0)).count() == 0


def _random_model():
    moves = np.log(np.random.default_rng(1).dirichlet(np.ones(chat_roles.STATES), chat_roles.STATES))
    seen = np.log(np.random.default_rng(2).dirichlet(np.ones(chat_roles.SYMBOLS), chat_roles.STATES))
    return moves[0], moves, seen


def test_chat_in_parts_is_decoded_and_rendered_as_in_one_pass(spark):
    texts = ["one line", "two\nlines", "", "blank\n\n\ninside", "ends blank\n\n", "\n\nstarts blank", "User: A: marker", "What?"]
    rows = [(c, None if t % 17 == 3 else t // 2, ["user", "assistant", "system", None][t % 4], None if t % 13 == 5 else texts[(t * 7 + (c or 0)) % 8], "x", 1)
            for c in (1, 2, 3, 4, None) for t in range(60)]
    rows += [(1, None, "user", "tie", "x", 1)] * 5
    # "part" and "lines" clash with names that the operator uses itself
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, lines int").repartition(3)
    start, moves, seen = model = _random_model()

    def log_p(lines, states):
        obs = chat_roles.symbols_of(lines)
        return start[states[0]] + sum(moves[x, y] for x, y in zip(states, states[1:])) + sum(seen[x, o] for x, o in zip(states, obs))
    truths, same = [], 0
    for part in (1, 2, 64, 10_000):
        scripts = chat_roles.transcripts(df, part=part)
        truth = {}
        for r in sorted(scripts.collect(), key=lambda r: r.part):
            held = truth.setdefault(r.conv, ([], b""))
            truth[r.conv] = (held[0] + list(r.lines), held[1] + bytes(r.truth))
        truths.append(truth)
        out = {}
        for r in sorted(chat_roles.parse(scripts, model).collect(), key=lambda r: r.part):
            n, roles, text, states = out.get(r.conv, (0, "", [], b""))
            out[r.conv] = (n + r.n_turns, roles + r.roles, text + ([r.rendered] if r.rendered else []), states + bytes(r.states))
        for c, (n, roles, text, states) in out.items():
            lines = truth[c][0]
            best = chat_roles.decode(model, chat_roles.symbols_of(lines), -1, -1).tolist()
            # the same sequence, or another that is exactly as likely (the same moves in another order)
            assert log_p(lines, list(states)) == pytest.approx(log_p(lines, best), abs=1e-9)
            same += list(states) == best
            assert ("\n".join(text), n, roles) == chat_roles.render(lines, np.array(list(states)), -1, 0, True)
    assert truths[0] == truths[1] == truths[2] == truths[3] and set(truths[0]) == {1, 2, 3, 4, None} and same >= 16


def test_decoding_is_the_most_likely_sequence():
    import itertools

    start, moves, seen = model = _random_model()
    r = np.random.default_rng(7)
    for _ in range(20):
        obs = r.integers(0, chat_roles.SYMBOLS, 4).tolist()

        def p(states):
            return start[states[0]] + sum(moves[a, b] for a, b in zip(states, states[1:])) + sum(seen[s, o] for s, o in zip(states, obs))
        best = max(itertools.product(range(chat_roles.STATES), repeat=4), key=p)
        assert chat_roles.decode(model, obs, -1, -1).tolist() == list(best)
        m = chat_roles.span(model, obs, True)
        assert m.max() == pytest.approx(p(best))
