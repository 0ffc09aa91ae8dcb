"""Quality rules: line-first cleaning.

Every line is judged by itself, failing lines are removed, and a document that loses too much of its text
is rejected. One pass over the texts, no shuffle; a row needs memory for its own text only.

Line rules (a line without words neither fails nor counts):

* navigation: at least ``max_bars`` cell borders (``|``, ``>``) with at most ``cell_words`` words a cell, or at most ``short_line``
  words and no sentence mark at its end;
* boilerplate: equal to an earlier line, or more than ``boiler_share`` percent of its words stand in sentences with one of the fixed
  phrases (of any language, as texts mix them) or a brace (markup and code), so that one phrase does not fail a long paragraph;
* punctuation: more than ``symbol_share`` percent of its words carry one of ``#*$%&|<>``, or it has at least
  ``run_on`` words without any sentence mark.

A document is rejected if the removed words exceed ``max_lost`` percent of all, or if the base rules fail:
fewer than ``min_words`` words, or over ``max_repeat`` percent of the words in repeated 3-word windows.

Null texts count as empty: all figures 0 and, having fewer than ``min_words`` words, not kept. Repeated
rows and equal ids are judged one by one; other columns are not read and may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlens.llm.text import as_bytes, chunks

#: fixed phrases by language, lower case
BOILERPLATE = {
    "any": ("cookie", "javascript", "lorem ipsum", "copyright ©"),
    "en": ("all rights reserved", "privacy policy", "terms of use", "terms of service", "subscribe to", "sign up for", "click here", "read more",
           "share this"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "newsletter abonnieren",
           "jetzt anmelden", "hier klicken", "klicken sie hier", "mehr lesen", "weiterlesen", "impressum"),
    "fr": ("tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "abonnez-vous", "inscrivez-vous",
           "cliquez ici", "lire la suite", "en savoir plus", "partager cet article"),
    "es": ("todos los derechos reservados", "política de privacidad", "términos de uso", "condiciones de uso", "aviso legal", "suscríbete",
           "suscríbase", "regístrate", "haga clic aquí", "haz clic aquí", "leer más", "compartir este"),
}
#: as bytes; letters outside ASCII also as capitals, as lower-casing bytes leaves those
PHRASES = tuple(sorted({x for group in BOILERPLATE.values() for p in group for x in (p.encode(), p.upper().encode().lower())}))
#: sentences end behind a mark and white space, or behind a mark of scripts without spaces
SENTENCE = re.compile(r"(?<=[.!?;])[ \t\r\v\f\"')\]]+|(?<=…)|(?<=。)|(?<=！)|(?<=？)|(?<=।)")
SYMBOLS = b"#*$%&|<>"
MARKS = (b".", b"!", b"?", b":", b";", "…".encode(), "。".encode(), "！".encode(), "？".encode(), "؟".encode(), "।".encode())
CLOSERS = b"\"')]*_ \t\r\v\f"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat: int = 50
    max_lost: int = 50
    max_bars: int = 3
    cell_words: int = 6
    boiler_share: int = 50
    short_line: int = 3
    symbol_share: int = 30
    run_on: int = 400


def boilerplate_words(line: bytes, phrases: tuple[bytes, ...] = PHRASES) -> int:
    """Words of the line's sentences that have one of the phrases or a brace."""
    low = line.lower()
    if b"{" not in low and b"}" not in low and not any(p in low for p in phrases):
        return 0
    sentences = [x.encode("utf-8", "surrogateescape") for x in SENTENCE.split(low.decode("utf-8", "surrogateescape"))]
    return sum(len(x.split()) for x in sentences if b"{" in x or b"}" in x or any(p in x for p in phrases))


def line_fails(line: bytes, words: int, seen: bool, r: Rules, phrases: tuple[bytes, ...] = PHRASES) -> str:
    """Name of the rule that a line with words fails, else an empty string."""
    bars = line.count(b"|") + line.count(b" > ")
    if bars >= r.max_bars and words <= r.cell_words * (bars + 1):
        return "navigation"
    end = line.rstrip(CLOSERS)
    closed = end.endswith(MARKS)
    if words <= r.short_line and not closed:
        return "navigation"
    if seen or 100 * boilerplate_words(line, phrases) > r.boiler_share * words:
        return "boilerplate"
    if len(line) != len(line.translate(None, SYMBOLS)):
        marked = sum(len(w) != len(w.translate(None, SYMBOLS)) for w in line.split())
        if 100 * marked > r.symbol_share * words:
            return "punctuation"
    if words >= r.run_on and not closed and not any(m in line for m in MARKS):
        return "punctuation"
    return ""


def clean_lines(text: bytes, r: Rules) -> tuple[bytes, int, int]:
    """Text without its failing lines, words removed, lines (with a word) equal to an earlier one."""
    kept, lost, dups, seen = [], 0, 0, set()
    low = text.lower()
    phrases = tuple(p for p in PHRASES if p in low)  # one search of the text spares most lines theirs
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            kept.append(line)
            continue
        again = line in seen
        dups += again
        seen.add(line)
        if line_fails(line, n, again, r, phrases):
            lost += n
        else:
            kept.append(line)
    return (b"\n".join(kept) if lost else text), lost, dups


def repeated_words(h: np.ndarray, k: int = 3) -> int:
    """Words inside k-word windows that occur at least twice in the text, first occurrences included.

    Windows are compared by the words' own numbers, so unequal windows never meet.
    """
    if len(h) <= k:
        return 0
    _, w = np.unique(h, return_inverse=True)
    g, base = w[:len(w) - k + 1].astype(np.int64), int(w.max()) + 1
    for j in range(1, k):
        nxt = w[j:len(w) - k + 1 + j]
        if base ** (j + 1) >= 1 << 62:
            g = np.unique(g, return_inverse=True)[1].astype(np.int64)
        g = g * base + nxt
    _, inv, n = np.unique(g, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(n[inv] > 1)
    covered = np.zeros(len(w), bool)
    for j in range(k):
        covered[hit + j] = True
    return int(covered.sum())


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(),
           carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, base figures, verdict, ``lost_words``, ``clean_text``; carried columns as ``__c_`` + name."""
    carried = [(f"__c_{c}", docs.schema[c].dataType.simpleString()) for c in carry]
    src = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"), *[docs[c].alias(f"__c_{c}") for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            cols: list[list] = [[] for _ in range(8)]
            cleaned = []
            for c in chunks(texts, fold=False):
                for i in range(c.last - c.first):
                    t, h = texts[c.first + i], c.hash[c.bounds[i]:c.bounds[i + 1]]
                    s, e = c.start[c.bounds[i]:c.bounds[i + 1]], c.end[c.bounds[i]:c.bounds[i + 1]]
                    b = c.data[c.text_start[i]:c.text_start[i] + len(t)]
                    # continuation bytes (10xxxxxx) are inside words, so code points = word bytes less those
                    chars = int((e - s).sum()) - int(np.count_nonzero((b & 0xC0) == 0x80))
                    n, rep = len(h), repeated_words(h)
                    text, lost, dups = clean_lines(t, rules)
                    bad = n < rules.min_words or 100 * rep > rules.max_repeat * n
                    for k, v in enumerate((n, chars, len(t) - len(t.translate(None, SYMBOLS)), dups, rep, bad,
                                           not bad and 100 * lost <= rules.max_lost * n, lost)):
                        cols[k].append(v)
                    cleaned.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], *[pa.array(x, pa.int64()) for x in cols[:5]],
                 pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.bool_()), pa.array(cols[7], pa.int64()),
                 pa.array(cleaned, pa.binary()).cast(pa.string())],
                names=[id_col, *[c for c, _ in carried], *FIGURES, "clean_text"])

    fields = [f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}",
              *[f"`{c}` {kind}" for c, kind in carried],
              "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
              "kept boolean, lost_words long, clean_text string"]
    return src.mapInArrow(run, ", ".join(fields))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Rows of the kept documents with cleaned text (and ``n_chars`` brought up to date, where there is one)."""
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    j = judged(docs, id_col, text_col, rules, rest).where("kept")
    out = {c: F.col(f"__c_{c}") for c in rest} | {id_col: F.col(id_col), text_col: F.col("clean_text")}
    if "n_chars" in rest:
        out["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return j.select(*[out[c].alias(c) for c in docs.columns])
