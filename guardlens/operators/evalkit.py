"""Evaluation analytics over result tables: ablations, agreement, coverage, splits, diffs."""

from __future__ import annotations

from functools import reduce
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlens.functions import exprs as X
from guardlens.functions import ordered
from guardlens.functions.quantiles import exact_median, exact_quantile
from guardlens.operators import relational as R
from guardlens.session import cut


def ablation(cells: DataFrame, arm: str, base: str, count: Column, keep: Column | None = None) -> DataFrame:
    """Counts per arm and percent change against the base arm, optionally without excluded cells."""
    d = cells if keep is None else cells.where(keep)
    g = d.groupBy(arm).agg(F.sum(count).cast("long").alias("n_fail"), F.count(F.lit(1)).alias("n_cells"))
    ref = g.where(F.col(arm) == base).select("n_fail")
    b = ref.scalar()
    return g.withColumn("pct_vs_base", (F.col("n_fail") - b).cast("double") * 100.0 / b)


def monotone_order(arms: DataFrame, arm: str, order: Mapping[str, int], value: str) -> DataFrame:
    """Whether the arm values do not decrease in the declared order."""
    w = Window.orderBy("__o")  # one row per arm
    d = arms.withColumn("__o", F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col(arm)))
    d = d.withColumn("__p", F.lag(value).over(w))
    return d.agg((F.count_if(F.col(value) < F.col("__p")) == 0).alias("monotone"))


def firing_summary(violations: DataFrame, arms: Sequence[str], arm: str = "arm", check: str = "check_id") -> DataFrame:
    """Firing checks and violating rows per arm."""
    return violations.groupBy(arm).agg(F.count_distinct(check).alias("n_checks"), F.count(F.lit(1)).alias("n_rows"))


def arm_delta(full: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(run, check) pairs that fire only when the guard is off."""
    return R.new_keys(other, full, keys)


def duplicate_captures(hashes: DataFrame, keys: Sequence[str], h: Sequence[str]) -> DataFrame:
    """Fingerprints shared by two or more captures."""
    return hashes.groupBy(*h).agg(F.count(F.lit(1)).alias("n_captures"), F.min(F.struct(*keys)).alias("first")
                                  ).where(F.col("n_captures") > 1).select(*h, "n_captures", "first.*")


def clean_run_rollup(violations: DataFrame, runs: DataFrame, run: str = "run", check: str = "check_id") -> DataFrame:
    """Fires per check over clean runs and whether it fires on every run."""
    n_runs = runs.select(run).distinct().agg(F.count(F.lit(1)).alias("n"))
    g = violations.groupBy(check, run).agg(F.count(F.lit(1)).alias("c")).groupBy(check).agg(
        F.count(F.lit(1)).alias("n_runs_fired"), F.sum("c").alias("n_fires"), F.max("c").alias("max_fires"))
    return g.withColumn("universal", F.col("n_runs_fired") == n_runs.scalar())


def detection_outcome(is_buggy: Column, fired: Column) -> Column:
    return (F.when(is_buggy & fired, "DETECTED").when(is_buggy, "MISSED").when(fired, "FALSE_POSITIVE")
            .otherwise("TRUE_NEGATIVE"))


def method_table(verdicts: DataFrame, method: str, outcome: str) -> DataFrame:
    """Outcome counts, detection rate and false positive rate per method."""
    o = F.col(outcome)
    g = verdicts.groupBy(method).agg(
        F.count_if(o == "DETECTED").alias("detected"), F.count_if(o == "MISSED").alias("missed"),
        F.count_if(o == "FALSE_POSITIVE").alias("false_positive"), F.count_if(o == "TRUE_NEGATIVE").alias("true_negative"))
    return (g.withColumn("detection_rate", F.try_divide(F.col("detected"), F.col("detected") + F.col("missed")))
            .withColumn("fp_rate", F.try_divide(F.col("false_positive"), F.col("false_positive") + F.col("true_negative"))))


def regression_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fired checks that are new, fixed or persistent between two runs, with both counts."""
    a = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_old"))
    b = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_new"))
    kind = (F.when(F.col("n_old").isNull(), "new").when(F.col("n_new").isNull(), "fixed").otherwise("persistent"))
    return a.join(b, list(keys), "full_outer").select(
        *keys, F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"), kind.alias("change"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Raw agreement and chance-corrected agreement per group.

    Pairs reduce to label-pair counts first; everything after runs on the confusion table.
    """
    by = list(by)
    c = pairs.groupBy(*by, F.col(a).cast("string").alias("la"), F.col(b).cast("string").alias("lb")).agg(
        F.count(F.lit(1)).alias("c"))
    marg = (c.select(*by, F.inline(F.array(F.struct(F.col("la").alias("label"), F.col("c").alias("ca"), F.lit(0).cast("long").alias("cb")),
                                           F.struct(F.col("lb").alias("label"), F.lit(0).cast("long").alias("ca"), F.col("c").alias("cb")))))
            .groupBy(*by, "label").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb")))
    n = c.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("c")).otherwise(0)).alias("agree"))
    pe = marg.groupBy(*by).agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("__pe"))
    j = n.join(pe, by) if by else n.withColumn("__pe", pe.scalar())
    po = F.col("agree").cast("double") / F.col("n")
    e = F.col("__pe") / (F.col("n").cast("double") * F.col("n"))
    return j.select(*by, "n", po.alias("raw_agreement"), F.when(e != 1.0, (po - e) / (1.0 - e)).alias("kappa"))


def disagreements(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    return pairs.where(~F.col(a).eqNullSafe(F.col(b))).select(key, a, b)


def coverage_metrics(cases: DataFrame, by: Sequence[str], expressible: Column, groundable: Column, novel: Column) -> DataFrame:
    g = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(expressible).alias("n_schema"),
                               F.count_if(expressible & groundable).alias("n_joint"), F.count_if(novel).alias("n_novel"))
    return (g.withColumn("c_schema", F.col("n_schema") / F.col("n")).withColumn("c_joint", F.col("n_joint") / F.col("n")))


def stratified_split(cases: DataFrame, key: str, leak_key: Column, strata: Sequence[str], total: int, seed: int = 0,
                     span: int = 1 << 18) -> DataFrame:
    """Mark about ``total`` cases as test, proportional per stratum, without splitting leak groups.

    Cases with the same leak key form one group that is wholly in or out. Quotas are the largest
    remainder allocation over strata. Inside a stratum groups are taken in hash order while they
    fit the quota (cumulative size, two-level running sum), so a stratum is never one task.
    Sizes are bounded by the quotas; members depend on the hash seed.
    """
    g = cases.withColumn("__leak", F.coalesce(leak_key.cast("string"), F.col(key).cast("string")))
    groups = g.groupBy("__leak").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(key, *strata)).alias("rep"))
    groups = groups.select("__leak", "size", *[F.col(f"rep.{s}").alias(s) for s in strata],
                           X.hash_order(seed, "__leak").alias("h"))
    groups = cut(groups, "leak-groups")
    per = groups.groupBy(*strata).agg(F.sum("size").alias("n"))
    n_all = per.agg(F.sum("n").alias("t")).scalar()
    exact = F.lit(float(total)) * F.col("n") / n_all
    per = per.withColumn("exact", exact).withColumn("base", F.floor("exact").cast("long"))
    rest = F.lit(total) - per.agg(F.sum("base").alias("b")).scalar()
    w = Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), *[F.desc(s) for s in strata])  # one row per stratum
    quotas = per.withColumn("__r", F.row_number().over(w)).select(
        *strata, (F.col("base") + F.when(F.col("__r") <= rest, 1).otherwise(0)).cast("long").alias("quota"))
    run = ordered.running_sum(groups, F.col("size"), ordered.Order(tuple(strata), "h", ("__leak",), span), "cum")
    picked = run.join(quotas, list(strata)).select("__leak", (F.col("cum") <= F.col("quota")).alias("in_test"))
    return g.join(picked, "__leak").select(key, *strata, F.when(F.col("in_test"), "test").otherwise("dev").alias("split"))


def first_fit(items: DataFrame, size: str, key: str, ties: Sequence[str], cap: int, span: int = 1 << 18) -> DataFrame:
    """The items that a pass in the order of ``key`` takes when it takes whatever still fits into ``cap``.

    Done in rounds instead of one by one: a round takes the longest run from the front that fits (two-level running sums) and drops
    the items that are larger than what is left, the one that stopped it among them. The largest size falls each round, so there
    are at most as many rounds as different sizes.
    """
    rest, taken, left = cut(items.withColumn("__one", F.lit(0)), "fit"), None, cap
    while left > 0 and not rest.isEmpty():
        run = ordered.running_sum(rest, F.col(size), ordered.Order(("__one",), key, tuple(ties), span), "__cum")
        run = cut(run, "fit")
        fits = run.where(F.col("__cum") <= left)
        used = fits.agg(F.sum(size).alias("n")).first().n or 0
        taken = fits if taken is None else taken.unionByName(fits)
        rest = cut(run.where((F.col("__cum") > left) & (F.col(size) <= left - used)).drop("__cum"), "fit")
        left -= used
    out = (rest if taken is None else taken).select(*items.columns)
    return out.where(F.lit(taken is not None))


def quota_fill_split(cases: DataFrame, key: str, leak_key: Column, strata: Sequence[str], total: int, seed: int = 0, span: int = 1 << 18) -> DataFrame:
    """Mark ``total`` cases as test: quotas by stratum first, then a fill of the shortfall over all strata; leak groups stay whole.

    A stratum's groups are taken in hash order until its quota is reached, the last one may pass it; a group that would lift the test set
    above ``total`` is left out and later ones are tried. What is missing after all strata is filled from all other groups in hash order, again
    by whatever fits. If cases are still missing, the least exchange of chosen for other groups that closes the gap is made, if there is one.
    """
    g = cases.withColumn("__leak", F.coalesce(leak_key.cast("string"), F.col(key).cast("string")))
    groups = g.groupBy("__leak").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(key, *strata)).alias("rep"))
    groups = cut(groups.select("__leak", "size", *[F.col(f"rep.{s}").alias(s) for s in strata], X.hash_order(seed, "__leak").alias("h")), "leak-groups")
    per = groups.groupBy(*strata).agg(F.sum("size").alias("n"))
    exact = F.lit(float(total)) * F.col("n") / per.agg(F.sum("n").alias("t")).scalar()
    per = per.withColumn("exact", exact).withColumn("base", F.floor("exact").cast("long"))
    rest = F.lit(total) - per.agg(F.sum("base").alias("b")).scalar()
    every = Window.partitionBy(F.lit(0))  # one row per stratum
    by_rest = every.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), *[F.desc(s) for s in strata])
    quotas = per.withColumn("__r", F.row_number().over(by_rest)).withColumn("__no", F.row_number().over(every.orderBy(*strata))).select(
        *strata, "__no", (F.col("base") + F.when(F.col("__r") <= rest, 1).otherwise(0)).cast("long").alias("quota"))
    run = ordered.running_sum(groups, F.col("size"), ordered.Order(tuple(strata), "h", ("__leak",), span), "cum", inclusive=False)
    wanted = (_null_safe(run, quotas, strata).where(F.col("cum") < F.col("quota"))
              .select("__leak", "size", (F.col("__no") * F.lit(1 << 32) + F.col("h")).alias("place")))
    first = cut(first_fit(wanted, "size", "place", ["__leak"], total, span).select("__leak", "size"), "first-fit")
    short = total - (first.agg(F.sum("size").alias("n")).first().n or 0)
    others = groups.join(first, "__leak", "left_anti").select("__leak", "size", "h")
    second = first_fit(others, "size", "h", ["__leak"], short, span).select("__leak", "size")
    chosen = cut(first.unionByName(second), "chosen")
    short -= second.agg(F.sum("size").alias("n")).first().n or 0
    if short > 0:
        chosen = _exchanged(groups, chosen, short, total)
    picked = chosen.select("__leak", F.lit("test").alias("split"))
    return g.join(picked, "__leak", "left").select(key, *strata, F.coalesce("split", F.lit("dev")).alias("split"))


def _sums(sizes: dict[int, int], most: int) -> list[dict[int, int] | None]:
    """For each sum up to ``most``: how many groups of each size make it up, or None. Sizes and their numbers of groups are given."""
    out: list[dict[int, int] | None] = [{}] + [None] * most
    for size, n in sorted(sizes.items()):
        for at in range(most, size - 1, -1):
            if out[at] is None:
                for k in range(1, min(n, at // size) + 1):
                    if (rest := out[at - k * size]) is not None and size not in rest:
                        out[at] = {**rest, size: k}
                        break
    return out


def _exchanged(groups: DataFrame, chosen: DataFrame, short: int, total: int) -> DataFrame:
    """Chosen groups after the smallest exchange that adds ``short`` cases; unchanged if none does.

    Only the numbers of groups by size come to the driver, so at most as many as the largest group has cases.
    """
    others = groups.join(chosen, "__leak", "left_anti").select("__leak", "size")
    inside, outside = ({r["size"]: r["n"] for r in d.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()} for d in (chosen, others))
    top = max([*inside, *outside, 1])
    most = min(total, top * top)
    give, take = _sums(inside, most), _sums(outside, most + short)
    best = next((r for r in range(most + 1) if give[r] is not None and take[r + short] is not None), None)
    if best is None:
        return chosen

    def some(rows: DataFrame, wanted: dict[int, int]) -> DataFrame:
        return reduce(DataFrame.unionByName, [rows.where(F.col("size") == s).orderBy("__leak").limit(k) for s, k in wanted.items()], rows.limit(0))
    kept = chosen.join(some(chosen, give[best]).select("__leak"), "__leak", "left_anti")
    return kept.unionByName(some(others, take[best + short]))


def _null_safe(rows: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    right = few.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[c for c in few.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return rows.join(right, same).drop(*[f"__r_{c}" for c in on])


def temporal_split(cases: DataFrame, time: str, cutoff: str | None = None, train_fraction: float = 0.5) -> DataFrame:
    """Before the cutoff is train, the rest test; the cutoff defaults to the dated row at the fraction."""
    d = cases.where(F.col(time).isNotNull())
    if cutoff is not None:
        return d.withColumn("split", F.when(F.col(time) < F.lit(cutoff), "train").otherwise("test"))
    t = d.select(F.unix_micros(F.col(time).cast("timestamp")).cast("double").alias("t"))
    cut = exact_quantile(t, [], "t", train_fraction, "cutoff", "index_n").select("cutoff")
    return d.withColumn("split", F.when(F.unix_micros(F.col(time).cast("timestamp")) < cut.scalar(), "train").otherwise("test"))


def holdout_coverage(split: DataFrame, family: str, column: str = "split") -> DataFrame:
    """Test cases whose family was already seen on the training side."""
    seen = split.where(F.col(column) == "train").select(family).distinct().withColumn("__s", F.lit(1))
    t = split.where(F.col(column) == "test").groupBy(family).agg(F.count(F.lit(1)).alias("n_test"))
    return t.join(seen, family, "left").agg(F.sum("n_test").alias("n_test"),
                                            F.sum(F.when(F.col("__s") == 1, F.col("n_test")).otherwise(0)).alias("n_covered"))


def saturation(decisions: DataFrame, batch: str, decision: str, streak: int = 3) -> DataFrame:
    """Per batch: matched / singleton / new-template shares, cumulative coverage, ok-streak.

    Rows reduce to one per batch; the windows run over batches.
    """
    d = F.col(decision)
    g = decisions.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(d == "MATCH").alias("n_matched"),
        F.count_if(d == "SINGLETON").alias("n_singletons"), F.count_if(d == "NEW_TEMPLATE").alias("n_new_templates"))
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    ok = ((F.col("n_new_templates") == 0) & (F.col("n_matched") >= F.col("n_cases") * 0.95)
          & (F.col("n_singletons") < F.col("n_cases") * 0.05))
    g = g.withColumn("batch_ok", ok).withColumn("__island", F.sum((~ok).cast("int")).over(w))
    wi = Window.partitionBy("__island").orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    covered = F.col("n_matched") + F.col("n_new_templates")
    g = (g.withColumn("ok_streak", F.sum(F.col("batch_ok").cast("long")).over(wi))
         .withColumn("cum_cases", F.sum("n_cases").over(w)).withColumn("__cov", F.sum(covered).over(w)))
    return (g.withColumn("cum_coverage", F.col("__cov") / F.col("cum_cases")).withColumn("stop", F.col("ok_streak") >= streak)
            .drop("__island", "__cov"))


def order_bands(cases: DataFrame, key: str, label: str, n_orders: int, seed: int = 0, span: int = 1 << 18,
                seed_support: Mapping[str, int] | None = None) -> DataFrame:
    """Discovery and coverage curves over hash-shuffled orders, as median and 5-95 % bands.

    A label is discovered at its second occurrence (counting prior support). Positions are
    two-level ordinals per order; the second occurrence is the minimum after removing the first,
    two combinable aggregates instead of a list per label.
    """
    prior = F.lit(0)
    for k, v in (seed_support or {}).items():
        prior = F.when(F.col(label) == k, F.lit(v)).otherwise(prior)
    seeds = F.transform(F.sequence(F.lit(0), F.lit(n_orders - 1)), lambda i: i + seed)
    d = cases.select(key, label, F.explode(seeds).alias("order_no"))
    d = d.withColumn("h", X.hash_order(F.col("order_no"), key))
    d = ordered.with_ordinal(d, ordered.Order(("order_no",), "h", (key,), span), "pos").select("order_no", label, "pos")
    d = cut(d, "positions")
    lab = d.where(F.col(label).isNotNull())
    first = lab.groupBy("order_no", label).agg(F.min("pos").alias("p1"))
    second = (lab.join(first, ["order_no", label]).where(F.col("pos") > F.col("p1"))
              .groupBy("order_no", label).agg(F.min("pos").alias("p2")))
    found = (first.join(second, ["order_no", label], "left")
             .select("order_no", label, F.when(prior >= 2, 0).when(prior == 1, F.col("p1")).otherwise(F.col("p2")).alias("at"))
             .where(F.col("at").isNotNull()))
    d = d.join(found, ["order_no", label], "left")
    d = d.withColumn("__cov", (F.col("pos") >= F.col("at")).cast("long")).withColumn("__new", (F.col("pos") == F.col("at")).cast("long"))
    o = ordered.Order(("order_no",), "pos", (), 1 << 20)
    d = cut(d.select("order_no", "pos", "__cov", "__new"), "discoveries")
    d = ordered.running_sums(d, {"covered": F.col("__cov"), "templates": F.col("__new")}, o)
    d = d.withColumn("coverage", F.col("covered") / F.col("pos"))
    # every position has exactly n_orders rows
    pick = lambda c, i: F.element_at(F.sort_array(F.collect_list(c)), i + 1)
    mid, lo, hi = n_orders // 2, int(0.05 * n_orders), min(int(0.95 * n_orders), n_orders - 1)
    return d.groupBy("pos").agg(*[pick(c, i).alias(f"{c}_{n}") for c in ("templates", "coverage")
                                  for n, i in (("median", mid), ("p05", lo), ("p95", hi))])


def share_table(cases: DataFrame, rows: Sequence[str], flag: Column) -> DataFrame:
    g = cases.groupBy(*rows).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_true"))
    return g.withColumn("share", F.col("n_true") / F.col("n"))


def flag_class(flag: Column) -> Column:
    return (F.when(flag.startswith("PATTERN_AMBIGUOUS") | flag.startswith("CATEGORY_AMBIGUOUS"), "coding ambiguity")
            .when(flag.isin("SOURCE_ONLY_DETECTION", "EXCEEDS_TIER6"), "scope declaration")
            .when(flag.startswith("INFERRED_FROM"), "weak evidence").otherwise("other"))


def flag_summary(records: DataFrame, key: str, flags: str) -> DataFrame:
    """Records and instances per flag class."""
    f = records.select(key, F.explode(flags).alias("f")).withColumn("flag_class", flag_class(F.col("f")))
    return f.groupBy("flag_class").agg(F.count_distinct(key).alias("n_records"), F.count(F.lit(1)).alias("n_instances"))


def ambiguity_rate(records: DataFrame, category: str, flags: str) -> DataFrame:
    amb = F.exists(flags, lambda f: flag_class(f) == "coding ambiguity")
    return share_table(records, [category], amb)


def vocabulary_coverage(terms: DataFrame, term: str, mapping: Mapping[str, str]) -> DataFrame:
    """Known / unknown names of a vocabulary with their counts."""
    m = X.map_label(term, mapping)
    return terms.groupBy(term).agg(F.count(F.lit(1)).alias("n")).select(
        term, "n", m.alias("mapped_to"), m.isNotNull().alias("mapped"))


# Evidence words. Words matched inside any text are tested literally on the
# lower-cased text; the word-bounded ones keep a pattern behind a literal pre-test.
SILENT_OUTPUT = ("bug detected", "mismatch", "diverged", "wrong", "differs", "incorrect", "inconsistent", "clean")
CRASH_PLAIN = ("runtimeerror", "assertionerror", "cuda error")
CRASH_BOUNDED = ("crash", "oom", "nan", "inf")
SILENT_CAUSE = ("silently", "wrong value", "corrupted", "inconsistent", "undercount", "overcount", "duplicate", "missing",
                "not normalized", "dtype", "precision", "race", "reorder", "flag", "tag")
LOUD_CAUSE = ("throws", "raises", "crash", "segfault", "assertionerror", "runtimeerror")
SILENT_TITLE = ("skip", "wrong", "incorrect", "mismatch", "undercount", "lost", "duplicate", "precision", "dtype", "sync",
                "reduce")


def _crashes(low: Column) -> Column:
    # \b depends on the Java version: a word stands alone if no letter, digit or underscore of any script is beside it
    words, letter = "(?:" + "|".join(CRASH_BOUNDED) + ")", r"[\p{L}\p{N}_]"
    bounded = f"{words}(?!{letter})(?<!{letter}{words})"
    return X.contains_any(low, CRASH_PLAIN) | (X.contains_any(low, CRASH_BOUNDED) & low.rlike(bounded))


EVIDENCE_INPUTS = ("title", "description", "cause", "invariant", "method", "buggy_output", "fixed_output")


def score_evidence(records: DataFrame, reproduced: Column, keep: Sequence[str], **texts: Column) -> DataFrame:
    """Strength of evidence that a record describes a silent error, with warnings and signals.

    ``texts`` gives any of the seven text inputs. Each text is scanned once: the first projection
    holds the word tests, the second derives levels from them.
    """
    unknown = set(texts) - set(EVIDENCE_INPUTS)
    if unknown:
        raise ValueError(f"unknown evidence inputs {sorted(unknown)}")
    e = F.lit("")
    raw = {n: F.coalesce(texts[n], e) if n in texts else e for n in EVIDENCE_INPUTS}
    low = {n: F.lower(c) for n, c in raw.items()}
    some = lambda n, words: X.contains_any(low[n], words) if n in texts else F.lit(False)
    has = lambda n: (F.trim(raw[n]) != "") if n in texts else F.lit(False)
    b = (raw["buggy_output"] != "") if "buggy_output" in texts else F.lit(False)
    flags = records.select(
        *keep, F.coalesce(reproduced, F.lit(False)).alias("__rep"),
        (b & (_crashes(low["buggy_output"]) if "buggy_output" in texts else F.lit(False))).alias("__crash"),
        (b & (some("buggy_output", SILENT_OUTPUT) | some("fixed_output", SILENT_OUTPUT))).alias("__clean"),
        (some("description", LOUD_CAUSE) | some("cause", LOUD_CAUSE)).alias("__loud"),
        (some("cause", LOUD_CAUSE) | some("invariant", LOUD_CAUSE) | some("method", LOUD_CAUSE)).alias("__loud_cause"),
        (some("cause", SILENT_CAUSE) | some("invariant", SILENT_CAUSE) | some("method", SILENT_CAUSE)).alias("__silent"),
        (has("cause") | has("invariant") | has("method")).alias("__any"), has("invariant").alias("__inv"),
        some("title", SILENT_TITLE).alias("__title"))
    c = F.col
    l1 = c("__rep") & c("__clean") & ~c("__crash")
    l2 = c("__any") & c("__silent") & ~c("__loud_cause")
    level = F.when(l1, "L1").when(l2, "L2").when(c("__title"), "L3").otherwise("L4")
    warned = c("__crash") | c("__loud")
    kept = lambda *xs: F.array_join(F.array_compact(F.array(*xs)), ",")
    return flags.withColumn("underlying_level", level).select(
        *keep, "underlying_level", F.when(warned, "WARNING").otherwise(c("underlying_level")).alias("evidence_level"),
        kept(F.when(l1, F.lit("reproduced")), F.when(l1, F.lit("expected_output_silent_keyword")),
             F.when(l1 & ~c("__loud"), F.lit("fix_diff_no_raise")),
             F.when(c("underlying_level") == "L2", F.lit("root_cause_silent_keyword")),
             F.when((c("underlying_level") == "L2") & c("__inv"), F.lit("invariant_present")),
             F.when(c("underlying_level") == "L3", F.lit("title_silent_keyword")),
             F.when(c("underlying_level") == "L4", F.lit("no_clean_signal"))).alias("signals"),
        kept(F.when(c("__crash"), F.lit("crash_keyword_in_buggy_output")),
             F.when(c("__loud"), F.lit("loud_keyword_in_description"))).alias("warnings"),
        (warned | (c("underlying_level") == "L4")).alias("needs_review"))


def timing_summary(iterations: DataFrame, by: Sequence[str], order: str, value: str, base: Column) -> DataFrame:
    """Mean / median / min / max without the first iteration of each group, and factor over the base group."""
    first = iterations.groupBy(*by).agg(F.min(order).alias("__first"))
    d = iterations.join(first, list(by)).where(F.col(order) > F.col("__first"))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_iters"), F.avg(value).alias("mean"), F.min(value).alias("min"),
                           F.max(value).alias("max"))
    med = exact_median(d, list(by), value, "median").drop("n")
    ref = g.where(base).select("mean").scalar()
    return g.join(med, list(by)).withColumn("vs_baseline", F.col("mean") / ref)


def corpus_merge(base: DataFrame, override: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Override wins column by column; rows where both sides disagree are flagged."""
    b = base.select(key, *[F.col(c).alias(f"__b_{c}") for c in columns]).withColumn("__in_b", F.lit(1))
    o = override.select(key, *[F.col(c).alias(f"__o_{c}") for c in columns]).withColumn("__in_o", F.lit(1))
    j = b.join(o, key, "full_outer")
    diff = F.lit(False)
    for c in columns:
        diff = diff | (F.col(f"__b_{c}").isNotNull() & F.col(f"__o_{c}").isNotNull() & (F.col(f"__b_{c}") != F.col(f"__o_{c}")))
    src = F.when(F.col("__in_b").isNull(), "override").when(F.col("__in_o").isNull(), "base").otherwise("both")
    return j.select(key, *[F.coalesce(f"__o_{c}", f"__b_{c}").alias(c) for c in columns], src.alias("source"), diff.alias("disagrees"))


def record_validation(records: DataFrame, expected: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Duplicate keys, missing keys, unknown keys and empty required fields, as counts."""
    per = records.groupBy(key).agg(F.count(F.lit(1)).alias("c"), *[F.count_if(F.col(r).isNull()).alias(f"__n_{r}") for r in required])
    j = per.join(expected.select(key).distinct().withColumn("__e", F.lit(1)), key, "full_outer")
    return j.agg(F.count_if(F.col("c") > 1).alias("n_duplicate_keys"), F.count_if(F.col("c").isNull()).alias("n_missing_keys"),
                 F.count_if(F.col("__e").isNull()).alias("n_unknown_keys"),
                 *[F.coalesce(F.sum(f"__n_{r}"), F.lit(0)).cast("long").alias(f"n_null_{r}") for r in required])


def staircase(cases: DataFrame, step: str, total: DataFrame | None = None) -> DataFrame:
    """Cases per step with cumulative count and percent; the window runs over steps."""
    g = cases.groupBy(step).agg(F.count(F.lit(1)).alias("n_cases"))
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    n = (total or cases).agg(F.count(F.lit(1)).alias("n")).scalar()
    g = g.withColumn("cumulative", F.sum("n_cases").over(w))
    return g.withColumn("cumulative_pct", F.col("cumulative") * 100.0 / n)


def holdout_pool(cases: DataFrame, key: str, pattern: str) -> DataFrame:
    return cases.withColumn("pool", F.when(F.col(key).cast("string").rlike(pattern), "holdout").otherwise("main"))


def yield_by_arm(results: DataFrame, arm: str, repetition: str, survivors: Column, base: str) -> DataFrame:
    """Survivors per arm and repetition, median per arm and ratio to the base arm."""
    per = results.groupBy(arm, repetition).agg(F.sum(survivors).cast("double").alias("yield"))
    med = exact_median(per, [arm], "yield", "median_yield").select(arm, "median_yield", F.col("n").alias("n_repetitions"))
    ref = med.where(F.col(arm) == base).select("median_yield").scalar()
    return med.withColumn("ratio", F.col("median_yield") / ref)


def line_counts(lines: DataFrame, file: str, line: str, claims: DataFrame | None = None, factor: float = 1.5) -> DataFrame:
    """Total and code lines per file; with claims, whether either count is inside the factor band."""
    t = F.trim(line)
    g = lines.groupBy(file).agg(F.count(F.lit(1)).alias("total_lines"),
                                F.count_if((t != "") & ~t.startswith("#")).alias("code_lines"))
    if claims is None:
        return g
    claimed = F.nullif(F.col("claimed"), F.lit(0))
    near = [(F.col(c) / claimed).between(1 / factor, factor) for c in ("total_lines", "code_lines")]
    return g.join(claims, file).withColumn("in_band", near[0] | near[1])
