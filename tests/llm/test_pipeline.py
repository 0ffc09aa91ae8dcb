"""The pipeline against a brute-force version of its five stages, and the contract of its queries."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
from guardlens.llm import quality, queries

from llm_rows import prose

SPACE = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def kept(text):
    w = SPACE.findall(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    rep = len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)})
    lines, lost, before = [], 0, set()
    for line in text.split("\n"):
        n = len(SPACE.findall(line))
        if n and quality.line_fails(line.encode(), n, line in before, quality.Rules()):
            lost += n
        else:
            lines.append(line)
        before |= {line} if n else set()
    ok = len(w) >= 50 and 100 * rep <= 50 * len(w) and 100 * lost <= 50 * len(w)
    return "\n".join(lines) if ok else None


def one_of_each(docs):
    sets = {}
    for i, (t, _) in docs.items():
        w = SPACE.findall(low(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    part = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = part[i], part[j]
                part = {k: min(a, b) if v in (a, b) else v for k, v in part.items()}
    return {i: d for i, d in docs.items() if part[i] == i}


def clean(docs, items):
    windows = set()
    for t in items:
        w = ALNUM.findall(low(t))
        m = min(10, len(w))
        windows |= {tuple(w[k:k + m]) for k in range(len(w) - m + 1)} if m else set()
    out = {}
    for i, d in docs.items():
        w = ALNUM.findall(low(d[0]))
        if not any(tuple(w[k:k + m]) in windows for m in {len(x) for x in windows} for k in range(len(w) - m + 1)):
            out[i] = d
    return out


def mix(docs):
    size = {i: len(SPACE.findall(t)) for i, (t, _) in docs.items()}
    total = Counter()
    for i, (_, s) in docs.items():
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while True:  # share, stop those above, share the rest again
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: weight[s] * unit for s in open_}
    copies = {}
    for s in order:
        full = int(target[s] // total[s]) if total[s] else 0
        rest, at = target[s] - full * total[s], 0
        mine = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16), i) for i, d in docs.items() if d[1] == s)
        stopped = False
        for _, i in mine:
            more = not stopped and (at + size[i] <= rest or at + size[i] - rest < rest - at)
            stopped |= at + size[i] > rest
            at += size[i]
            copies[i] = full + more
    return copies


def fixture():
    body = prose(1, 150)
    rows = [(0, body, "b"), (1, body, "b"), (2, body.replace("alpha", "omega", 1), "a")]
    for k in range(3, 40):
        t = prose(50 + k, 60 + 5 * (k % 9))
        rows.append((k, t + ("\nAll rights reserved." if k % 5 == 0 else ""), "b" if k % 3 else (None if k % 4 == 0 else "c")))
    rows += [(40, None, "a"), (41, "", "a"), (42, "x | y | z | w\n" * 30, "a"), (43, prose(53, 60)[:200] + " " + prose(99, 90), "a")]
    items = [(1, " ".join(ALNUM.findall(low(prose(60, 80)))[20:34])), (2, None), (3, "not in there at all")]
    return rows, items


def test_pipeline_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = fixture()
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(
        3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = {i: (kept(t), s) for i, t, s in rows if t and kept(t) is not None}
    docs = clean(one_of_each(docs), [t for _, t in items if t])
    assert 0 < len(docs) < len(rows)
    copies = mix(docs)
    tok = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    want, at = [], 0
    for i in sorted(docs):
        ids = [*tok.encode(docs[i][0], add_special_tokens=False).ids, 2]
        for _ in range(copies[i]):
            want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            at += len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(want)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert k == 4 or out.columns == docs.columns


def test_registered_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
