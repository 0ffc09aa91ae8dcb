"""Cases that an operator once did only in part."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from llm_rows import prose
from guardlens.llm import decontaminate, fim, hpyp, importance, jaccard_join, license_scan, text, url_filter


def test_bridge_between_clusters_of_which_the_later_one_is_larger():
    made = iter(range(1 << 20))

    def new(k: int) -> list[int]:
        return [next(made) for _ in range(k)]

    def variants(s: list[int], k: int) -> list[list[int]]:
        return [s[:5 * i] + s[5 * i + 10:] + new(10) for i in range(k)]

    y = new(100)
    x, b = y[:86] + new(14), y[14:] + new(14)   # x - y - b, but not x - b
    c = x[14:] + new(14)                        # c - x, but not c - y
    others = [x[86:] + new(86) for _ in range(60)]
    sets = [np.array(sorted(s), np.uint64) for s in [c, x, b, y, *variants(c, 8), *variants(b, 16), *others]]
    found = dict(jaccard_join.link_cell(np.arange(len(sets)), np.array([len(s) for s in sets]), [s.tobytes() for s in sets]))
    assert [found.get(i, i) for i in range(len(sets))] == [0] * 28 + list(range(28, len(sets)))


def test_notice_twice_in_a_long_text_and_stray_words_far_away(spark):
    isc = license_scan.TEMPLATES["isc"]
    words, noise = isc.split(), "the software and this notice is for any use with words of no license at all. " * 200
    changed = " ".join([*words[:-2], "every", "copy."])  # "all" stands far behind, in the noise
    df = spark.createDataFrame([(1, f"{isc} {noise} {isc}"), (2, f"{changed} {noise}"), (3, f"{noise} {changed}"), (4, noise),
                                (5, f"{license_scan.TEMPLATES['apache-2.0-notice']} {noise}")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [got[k].license for k in (1, 2, 3, 4, 5)] == ["isc"] * 3 + [None, "apache-2.0-notice"]
    assert (got[1].coverage, got[1].start_word, got[1].end_word) == (1.0, 0, got[1].template_words)
    assert got[2].start_word == 0 and got[2].matched >= got[2].template_words - 2
    assert got[4].licenses == [] and {"apache-2.0-notice", "apache-2.0-short"} <= set(got[5].licenses)


def best_stretch(text: list[int], template: list[int]) -> tuple[int, int]:
    """Brute force: most words that any stretch matches with coverage 80 and density 50, and the least length that does."""
    best = (0, 0)
    for a in range(len(text)):
        for b in range(a + 1, min(len(text), a + 2 * len(template)) + 1):
            m = len(license_scan.lcs_pairs(text[a:b], template))
            if 100 * m >= 80 * len(template) and 100 * m >= 50 * (b - a):
                best = max(best, (m, a - b))
    return best


def test_license_windows_against_every_stretch():
    r = np.random.default_rng(3)
    same = found = 0
    for _ in range(150):
        template = r.integers(0, 14, r.integers(3, 12))
        copy = [x for x in template.tolist() if r.random() > 0.05]
        text = [*r.integers(0, 14, r.integers(0, 20)).tolist(), *copy, *r.integers(0, 14, r.integers(0, 20)).tolist(), *copy]
        m, a, b = license_scan.best_match(np.array(text), template)
        want = best_stretch(text, template.tolist())
        assert m <= want[0] and (not m or (100 * m >= 80 * len(template) and 100 * m >= 50 * (b - a)))
        assert m == 0 or len(license_scan.lcs_pairs(text[a:b], template.tolist())) >= m
        if want[0] == len(template) == -want[1]:
            assert (m, b - a) == (len(template), len(template))  # verbatim copies are always found
        found += want[0] > 0
        same += m == want[0] > 0
    assert found > 100 and same >= 0.95 * found


def test_words_shared_with_a_window():
    r = np.random.default_rng(4)
    for _ in range(100):
        h, t, n = r.integers(0, 8, r.integers(1, 40)), r.integers(0, 6, r.integers(1, 9)), int(r.integers(1, 15))
        want = [sum(min((h[s:s + n] == w).sum(), (t == w).sum()) for w in np.unique(t)) for s in range(len(h))]
        assert license_scan.shared_words(h, t, n).tolist() == want


def test_every_notice_is_told_from_its_relatives_in_long_texts(spark):
    names = list(license_scan.TEMPLATES)
    assert len(names) >= 35 and len(set(license_scan.TEMPLATES.values())) == len(names)
    rows = [(k, f"{prose(900 + k, 300)} {license_scan.TEMPLATES[n]} {prose(950 + k, 300)}") for k, n in enumerate(names)]
    edited = []
    for k, n in enumerate(names):
        w = license_scan.TEMPLATES[n].split()
        if len(w) >= 40:  # one word in fifteen changed, and a line put between
            w = [x if i % 15 != 7 else "changed" for i, x in enumerate(w)]
            edited.append((1000 + k, f"{prose(900 + k, 300)} {' '.join(w[:20])} a line between {' '.join(w[20:])} {prose(950 + k, 300)}"))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows + edited, "doc_id long, text string")).collect()}
    for k, n in enumerate(names):
        assert n in got[k].licenses and got[k].license == n and got[k].coverage == 1.0, (n, got[k].license)
    assert len(edited) > 20
    for k, _ in edited:
        assert names[k - 1000] in got[k].licenses and got[k].coverage > 0.85


def test_a_million_words_of_notices_are_read_in_linear_time():
    template = np.unique(np.arange(160))
    r = np.random.default_rng(6)
    for text in (np.tile(template, 6000), r.permutation(np.tile(template, 600))):
        m, a, b = license_scan.best_match(text, template)
        assert m == 0 or b - a <= 320
    assert license_scan.best_match(np.tile(template, 6000), template) == (160, 0, 160)


def test_rows_are_kept_and_dropped_by_row_not_by_id(spark):
    a, b, c, d = (prose(700 + k, 60) for k in range(4))
    rows = [(None, a, 0), (None, a, 1), (None, b, 2), (7, b, 3), (7, c, 4), (1, c, 5), (7, d, 6), (None, "", 7), (None, None, 8), (7, "", 9), (7, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long").coalesce(1)
    stay = jaccard_join.one_of_each(docs)
    assert sorted(r.k for r in stay.collect()) == [0, 3, 5, 6, 7, 8, 9, 10] and stay.columns == docs.columns
    items = spark.createDataFrame([(1, " ".join(b.split()[20:34]))], "item_id long, text string")
    clean = decontaminate.clean_documents(docs, items)
    assert sorted(r.k for r in clean.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10] and clean.columns == docs.columns


def test_url_tokens_have_their_own_counts_and_words_any_length(spark):
    long = "достопримечательность"  # 42 bytes
    odd = [chr(97 + k // 676) + chr(97 + k // 26 % 26) + chr(97 + k % 26) for k in range(17576)]
    rows = [(0, "http://h.com/aaa", f"кот {long} " * 9), (1, f"http://кот{long}.com/", None)]
    rows += [(2 + k, f"http://x.{'net' if k % 2 else 'org'}/fr/" + "/".join(f"{w}{v}" for w in odd[k::40] for v in odd[:5]), "x") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [{r.page_id: r for r in url_filter.judged(pages, broadcast_tokens=n).collect()} for n in (1 << 20, 0)]
    assert [r.score for r in got[0].values()] == [got[1][k].score for k in got[0]]
    assert got[0][1].host_words == f"кот {long} com"
    # fr, x and org or net, and 87,880 pieces; no piece of the page 0 but unseen ones
    half = [sum(len(odd[k::40]) * 5 for k in range(s, 40, 2)) for s in (0, 1)]
    seen = 4 + sum(half)
    unseen = math.log(half[0] + 60 + seen) - math.log(half[1] + 60 + seen)
    assert abs(got[0][0].score - 3 * unseen) < 1e-9


def test_a_region_of_few_very_long_sets_is_cut_into_blocks(spark):
    rows = spark.createDataFrame([(1, e, 1000, b"") for e in range(40)], "p long, e long, n long, elements binary")
    cells: dict[int, set[int]] = {}
    for r in jaccard_join._blocks(rows, jaccard_join._sizes(rows), 1000, 20_000).collect():
        cells.setdefault(r.p, set()).add(r.e)
    assert max(map(len, cells.values())) < 40  # one cell by the number of sets, 40,000 shingles in four blocks
    assert all(any({a, b} <= c for c in cells.values()) for a in range(40) for b in range(40))


def test_hashes_of_substrings_are_those_of_words():
    raw = ("abcdefghij" * 30 + "été" * 20).encode()
    for size in (1, 2, 7, 60):
        got = url_filter.run_hashes(raw, size)
        for a in range(0, len(raw) - size + 1, 13):
            _, _, h = text.hash_words(np.frombuffer(raw[a:a + size], np.uint8), url_filter.BY_LETTER)
            assert got[a] == h[0]


def test_a_very_long_host_is_segmented(spark):
    words = ["cat", "dog", "house", "sat", "at", "a"]
    r = random.Random(8)
    host = "".join(r.choice(words[:4]) for _ in range(25_000)) + "q" * 200
    pages = spark.createDataFrame([(0, "http://h.com/x", " ".join(words * 30) + " " + "z" * 150), (1, f"http://{host}/", None)], "page_id long, url string, html string")
    got = {x.page_id: x for x in url_filter.judged(pages).collect()}
    split = got[1].host_words.split(" ")
    assert "".join(split) == host and set(split[:-1]) <= set(words) and split[-1] == "q" * 200


def test_best_split_of_random_runs_against_all_splits():
    r = random.Random(5)
    for _ in range(200):
        run = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        known = {(a, b): r.choice([1, 5, 900, 10 ** 6]) for a in range(len(run)) for b in range(a + 1, len(run) + 1) if r.random() < .3}
        total = 10 ** 6

        def p(cuts):
            return sum(math.log10(known[a, b] / total) if (a, b) in known else 1 - math.log10(total) - (b - a) for a, b in zip(cuts, cuts[1:]))
        every = [[0, *[k + 1 for k in range(len(run) - 1) if m >> k & 1], len(run)] for m in range(1 << (len(run) - 1))]
        got = url_filter.best_split(run, known, total)
        cuts = [0]
        for w in got:
            cuts.append(cuts[-1] + len(w))
        assert abs(p(cuts) - max(map(p, every))) < 1e-9


def test_a_flat_vocabulary_fills_the_frequent_words(spark):
    flat = spark.createDataFrame([(k * 7919, 3) for k in range(60)], "h long, n long")
    assert 14 <= len(hpyp.most_frequent(flat, 20)) <= 20 and len(hpyp.most_frequent(flat, 60)) == 60 and len(hpyp.most_frequent(flat, 0)) == 0
    mixed = flat.union(spark.createDataFrame([(1, 1000), (2, 500), (3, 1)], "h long, n long"))
    got = hpyp.most_frequent(mixed, 12).to_pydict()
    assert {1, 2} <= set(got["h"]) and 3 not in got["h"] and 8 <= len(got["h"]) <= 12
    many = spark.range(200_000).select(F.col("id").alias("h"), F.lit(2).cast("long").alias("n"))
    assert 900 <= len(hpyp.most_frequent(many, 1000)) <= 1000


def test_columns_of_other_names_are_not_read(spark, docs):
    """Tables whose further columns bear the names that operators use themselves give the same rows."""
    names = ["row", "id", "n", "h", "cand", "words", "fp", "item", "salt", "items", "spans", "pos", "data", "form", "score", "rank", "n_features", "buckets", "e", "p", "key"]
    wide = docs.select("doc_id", "text", "source", *[F.lit("x").alias(n) for n in names])
    items = spark.createDataFrame([(1, prose(1, 30)), (None, prose(3, 12)), (2, None)], "item_id long, text string")
    more = items.select("item_id", "text", *[F.lit(7).alias(n) for n in names])
    plain = docs.select("doc_id", "text", "source")
    rows = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    assert rows(decontaminate.digests(decontaminate.decontaminate(wide, more), "doc_id")) == rows(decontaminate.digests(decontaminate.decontaminate(plain, items), "doc_id"))
    assert rows(fim.report(wide)) == rows(fim.report(plain))
    assert rows(importance.report(wide, more)) == rows(importance.report(plain, items))
    assert decontaminate.clean_documents(wide, more).columns == wide.columns and jaccard_join.one_of_each(wide).columns == wide.columns


def test_empty_tables_give_no_rows(empty):
    from guardlens.llm import quality, wordpiece
    from guardlens.llm.queries import tokenizer_file
    assert license_scan.scan(empty).count() == 0 and quality.judged(empty).count() == 0
    assert wordpiece.token_counts(empty, tokenizer_file("byte_bpe_50k.json")).count() == 0
    none = empty.select(empty.doc_id.alias("item_id"), "text")
    assert decontaminate.decontaminate(empty, none).count() == 0
