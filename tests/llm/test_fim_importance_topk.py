"""Fill-in-middle, importance resampling and top-k search against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_rows import prose
from guardlens.llm import fim, importance, topk

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
text_id = lambda i: "" if i is None else str(i)


# -- fill in the middle

def fim_row(i, t):
    t = t or ""
    units = UNIT.findall(t)
    assert "".join(units) == t
    h = [int(sha(f"42:{text_id(i)}")[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return (i, len(units), form, *((None, None) if form == "plain" else (len(p), len(m)))), out, t


@pytest.fixture(scope="module")
def fim_rows(rows):
    more = [(100 + k, prose(900 + k, 3 + 7 * k)) for k in range(40)]
    more += [(200 + k, t) for k, t in enumerate(["<P> a b c", "a <M>b", "<S>", "<", "<P", "P> <P", "<<S", "< P>", " ", "\n", "a", " a ", "é   x", "\x1c \x85", "<M<M b"])]
    more += [(300 + k, "a" * k + " <" * 9 + "é" * 50) for k in range(12)]
    return [(i, t) for i, t, *_ in rows] + more


@pytest.mark.parametrize("units,size", [(fim.UNITS, fim.PIECE_BYTES), (2, 5)])
def test_fim_outputs_digests_and_rebuilt_texts(spark, fim_rows, units, size):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in fim_rows], "doc_id long, text string, form string, row int").repartition(3)
    want = [fim_row(i, t) for i, t in fim_rows]
    got = fim.report(df, units=units, piece_bytes=size)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((*head, sha(out), sha(t))) for head, out, t in want)
    texts = fim.outputs(fim.pieces(df, units=units, piece_bytes=size)).collect()
    assert sorted((text_id(r.id), r.form, r.text) for r in texts) == sorted((text_id(h[0]), h[2], o) for h, o, _ in want)
    assert {fim.rebuild(r.text.encode(), r.form).decode() for r in texts} == {t for *_, t in want}


def test_fim_pieces_are_bounded_and_a_long_text_streams(spark):
    long = "x" * 300_000 + " " + prose(5, 30_000)
    ident = next(i for i in range(99) if fim_row(i, long)[0][2] != "plain")
    df = spark.createDataFrame([(ident, long), (None, None)], "doc_id long, text string")
    parts = fim.pieces(df)
    assert parts.selectExpr("max(length(data))").first()[0] <= fim.PIECE_BYTES
    assert parts.count() > 10
    head, out, t = fim_row(ident, long)
    got = {r.doc_id: tuple(r) for r in fim.report(df).collect()}
    assert got[ident] == (*head, sha(out), sha(t)) and got[None] == (None, 0, "plain", None, None, sha(""), sha(""))


def test_fim_chunks_cover_the_units():
    t = prose(4, 60).encode() + b"  "
    ends = fim.unit_ends(np.frombuffer(t, np.uint8))
    for a in range(0, len(ends) + 1, 5):
        for b in range(a, len(ends) + 1, 7):
            got = list(fim._chunks(ends, a, b, 3, 7))
            lo, hi = (int(ends[k - 1]) if k else 0 for k in (a, b))
            assert b"".join(t[s:e] for s, e in got) == t[lo:hi] and all(0 < e - s <= 7 for s, e in got)


def test_fim_empty_table(empty):
    assert fim.report(empty).count() == 0 and fim.outputs(fim.pieces(empty)).count() == 0


# -- importance resampling

def words_of(t):
    return ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def features_of(t):
    w = words_of(t)
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def importance_rows(docs, items):
    s, t = (Counter(b for x in texts for b in features_of(x)) for texts in ([t for _, t in docs], items))
    S, T = s.total(), t.total()
    out = []
    for i, x in docs:
        f = features_of(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f) // len(f) if f else 0
        h = int(sha(f"7:{text_id(i)}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def importance_docs(rows):
    more = [(500 + k, prose(600 + k, 15 + k)) for k in range(60)] + [(7, prose(1, 40))] * 9 + [(None, prose(2, 44))] * 3
    return [(i, t) for i, t, *_ in rows] + more + [(900, "z" * 70_000 + " " + "yy " * 40_000 + "Ω" * 60)]


def test_importance_weights_scores_and_ranks(spark, importance_docs):
    items = [prose(600, 200), None, "", "one", "ALPHA beta."]
    df = spark.createDataFrame([(i, t, 5) for i, t in importance_docs], "doc_id long, text string, score long").repartition(5)
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, row int")
    assert sorted(str(list(r)) for r in importance.report(df, bench).collect()) == importance_rows(importance_docs, items)
    drawn = importance.drawn_documents(df, bench)
    n = sum(len(words_of(t)) >= 20 for _, t in importance_docs)
    assert drawn.columns == df.columns and drawn.count() == 25 * n // 100


def test_importance_empty_tables(spark, empty, importance_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.report(empty, none).count() == 0
    few = importance_docs[-30:-1]
    df = spark.createDataFrame(few, "doc_id long, text string")
    assert sorted(str(list(r)) for r in importance.report(df, none).collect()) == importance_rows(few, [])


def test_buckets_do_not_depend_on_slices(monkeypatch):
    texts = [prose(3, 400).encode(), b"", "été Été x".encode() * 30, b"-", b"A" * 500 + b" b", b" " * 300 + b"end"]
    whole = importance.group_buckets(texts, importance.Splitter(), 10000)
    for size in (16, 64, 1000):
        monkeypatch.setattr(importance, "SLICE", size)
        words, found = importance.group_buckets(texts, importance.Splitter(), 10000)
        assert words == whole[0] == [len(words_of(t.decode())) for t in texts]
        for t, got, one in zip(texts, found, whole[1]):
            assert Counter(np.frombuffer(got, np.uint16)) == Counter(np.frombuffer(one, np.uint16)) == Counter(features_of(t.decode()))


def test_crc_extend_is_crc32():
    r = np.random.default_rng(5)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    start, n = r.integers(0, 4000, 300), r.integers(0, 120, 300)
    first = importance.crc_extend(np.zeros(300, np.uint32), data, start, n)
    raw = data.tobytes()
    assert first.tolist() == [zlib.crc32(raw[s:s + k]) for s, k in zip(start.tolist(), n.tolist())]
    assert importance.crc_extend(first, data, start, n).tolist() == [zlib.crc32(raw[s:s + k] * 2) for s, k in zip(start.tolist(), n.tolist())]


# -- top-k search

def best(vectors, k=10):
    ok = [(r, i, [math.floor(1024 * x) for x in v]) for r, (i, v) in enumerate(vectors)
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, i, q in ok:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j is None, j or 0, s) for s, j, x in ok if s != r)[:k]
        out += [(i, rank + 1, None if null else j, -score) for rank, (score, null, j, _) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(11)
    out = [(i, r.normal(size=5).round(2).tolist()) for i in range(400)]
    out += [(400 + i, [0.5, -0.25, 0.0, 1.0, 0.125]) for i in range(150)]            # one vector on many rows
    out += [(100, out[100][1]), (100, out[100][1]), (200, [9.0, 1.0])]                # repeated rows, equal ids, shorter vectors
    out += [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (600, None), (700, [None, 1.0]), (800, [math.nan, 1.0]), (900, [math.inf, 1.0]), (1000, []), (1100, [0.0] * 5)]
    return out


@pytest.mark.parametrize("block,group", [(4096, 1024), (37, 2)])
def test_topk_against_all_pairs(spark, vectors, block, group):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, score int, row int").coalesce(3)
    got = topk.report(df, block=block, group=group)
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(vectors)
    assert topk.report(df.limit(0)).count() == 0
    few = vectors[98:103]
    assert sorted((tuple(r) for r in topk.report(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect()), key=str) == best(few)


def test_topk_of_scores_beyond_64_bits_says_so(spark):
    big = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64"):
        topk.report(big).collect()


@pytest.mark.parametrize("dims,n,scale", [(3, 500, 50), (64, 700, 50), (70, 300, 50), (5, 400, 1 << 24)])
def test_reading_stops_early_and_keeps_every_contender(dims, n, scale):
    r = np.random.default_rng(dims)
    x = (r.normal(size=(n, dims)) * np.exp(r.normal(size=dims)) * scale).astype(np.int64)
    q = r.integers(-60 * scale, 60 * scale, (30, dims)) * (r.random((30, dims)) < .7)
    able = topk.contenders(topk.Lists(x), q, 7)
    for v, found in zip(q, able):
        score = x @ v
        assert set(np.flatnonzero(score >= np.sort(score)[-7])) <= set(found.tolist())
    assert min(map(len, able)) < n


def test_reading_ends_before_the_lists_do(monkeypatch):
    r = np.random.default_rng(1)
    x = np.sort(r.integers(0, 10_000, (4000, 2)), axis=0)  # the best stand first in both lists
    lists, depth = topk.Lists(x), []
    read = topk.Lists.read
    monkeypatch.setattr(topk.Lists, "read", lambda self, a, b, top: depth.append(b) or read(self, a, b, top))
    assert 3999 in topk.contenders(lists, np.array([[5, 3]]), 5)[0] and max(depth) < 200


def test_cell_of_an_empty_side():
    t = pa.table({"row": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "x": pa.array([], pa.binary())})
    assert topk.cell(t, t, 4, 3).num_rows == 0
