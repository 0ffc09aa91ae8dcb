"""Constraint trees of any depth: pointer doubling, adaptive evaluation, nested reports.

Nodes are rows (node, parent, ...); a root has a null parent. ``lifted`` climbs in rounds that double the distance covered, so a
chain of a thousand takes ten rounds and the state stays one row a node. ``drill_down`` evaluates a coarse check first and reads, for
the next finer one, only the partitions of keys that failed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlens.operators.diagnose import severity
from guardlens.session import cut


def lifted(nodes: DataFrame, marked: Column) -> DataFrame:
    """(node, root, depth, n_marked, far): for every node its root, the number of its ancestors and of the marked ones among them,
    and the marked ancestor farthest away (null without one).

    Each round joins a node's pointer with the state of the node it points to, for the nodes that have not reached a root yet. More rounds
    than doublings that the table allows mean a cycle, which is an error.
    """
    flags = nodes.select(F.col("node").alias("__p"), F.coalesce(marked, F.lit(False)).alias("__m"))
    start = (nodes.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("up"))
             .join(flags, F.col("up") == F.col("__p"), "left")
             .select("node", "up", F.lit(1).cast("long").alias("depth"), F.coalesce("__m", F.lit(False)).cast("long").alias("n_marked"),
                     F.when(F.col("__m"), F.struct(F.lit(1).cast("long").alias("at"), F.col("up").alias("node"))).alias("far")))
    state = cut(start.withColumn("open", F.lit(True)), "lift")
    left = max(1, nodes.count()).bit_length() + 1
    while not state.where("open").isEmpty():
        if not left:
            raise ValueError("the edges have a cycle")
        left -= 1
        nxt = state.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("depth").alias("__d"), F.col("n_marked").alias("__k"), F.col("far").alias("__f"))
        moved = state.where("open").join(nxt, F.col("up") == F.col("__n"), "left")
        far = F.when(F.col("__f").isNotNull(), F.struct((F.col("__f.at") + F.col("depth")).alias("at"), F.col("__f.node").alias("node"))).otherwise(F.col("far"))
        step = moved.select("node", F.coalesce("__up", "up").alias("up"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"),
                            (F.col("n_marked") + F.coalesce("__k", F.lit(0))).alias("n_marked"), far.alias("far"), F.col("__n").isNotNull().alias("open"))
        state = cut(step.unionByName(state.where("NOT open")), "lift")
    roots = nodes.where(F.col("parent").isNull()).select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_marked"),
                                                         F.lit(None).cast(nodes.schema["node"].dataType).alias("far"))
    return state.select("node", F.col("up").alias("root"), "depth", "n_marked", F.col("far.node").alias("far")).unionByName(roots)


def failure_chains(nodes: DataFrame) -> DataFrame:
    """Root causes as ``diagnose.root_causes`` gives them, for trees of any depth: failed nodes none of whose children failed, with the
    number of failed nodes on their way to the root and the farthest of those."""
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("status") == "fail").alias("n_failed_children"),
        F.count_if(F.col("status") == "pass").alias("n_passed_children"))
    lowest = (nodes.where("status = 'fail'").join(kids, "node", "left").fillna(0, ["n_children", "n_failed_children", "n_passed_children"])
              .where("n_failed_children = 0"))
    up = lifted(nodes, F.col("status") == "fail").select("node", "n_marked", "far")
    length = F.col("n_marked") + 1
    return lowest.join(up, "node").select(
        "node", "name", "level", length.alias("path_length"), F.coalesce("far", "node").alias("chain_start"),
        (F.col("n_children") == F.col("n_passed_children")).alias("children_all_pass"), severity(F.col("name"), length).alias("severity"))


@dataclass(frozen=True)
class Level:
    """A check of one level: ``keys`` name its nodes (the keys of the level before come first), ``check`` gives a row
    (keys..., status) for each node from the rows it is handed."""

    name: str
    keys: tuple[str, ...]
    check: Callable[[DataFrame], DataFrame]


def stored_by(rows: DataFrame, keys: Sequence[str], name: str = "levels") -> DataFrame:
    """The rows in folders by the coarsest key, so that a finer level reads the folders of failed keys only."""
    from guardlens.session import work_folder
    path = work_folder(rows.sparkSession, name)
    rows.write.partitionBy(*keys).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


BROADCAST_NODES = 100_000


def under(rows: DataFrame, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of failed nodes. A counted, small set of keys is broadcast, and prunes the folders of partitioned rows before they are read."""
    ids = failed.select(*keys).distinct()
    small = ids.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    return rows.join(F.broadcast(ids) if small else ids, list(keys), "left_semi")


def drill_down(rows: DataFrame, levels: Sequence[Level]) -> DataFrame:
    """(level, node, status) of all nodes that were evaluated: those of the first level, and children of failed nodes below.

    ``node`` is the keys joined by a slash. A level without failures ends the descent.
    """
    out, current = None, rows
    for i, lv in enumerate(levels):
        found = cut(lv.check(current).select(*lv.keys, "status"), f"level-{i}")
        part = found.select(F.lit(i).alias("level"), F.lit(lv.name).alias("check"), F.concat_ws("/", *[F.col(k).cast("string") for k in lv.keys]).alias("node"), "status")
        out = part if out is None else out.unionByName(part)
        failed = found.where("status = 'fail'")
        if i + 1 == len(levels) or failed.isEmpty():
            break
        current = under(rows, failed, lv.keys)
    return out


def agree(keys: Sequence[str], value: str) -> Callable[[DataFrame], DataFrame]:
    """Check: all rows of a node have one value; a node with a null value is an error."""
    def check(rows: DataFrame) -> DataFrame:
        g = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(value).isNull()).alias("n_null"))
        return g.withColumn("status", F.when(F.col("lo") != F.col("hi"), "fail").when(F.col("n_null") > 0, "error").otherwise("pass"))
    return check


def nested_report(nodes: DataFrame) -> DataFrame:
    """(root, n_nodes, n_fail, report): the tree under each root as nested JSON, children by name, folded from the deepest level up.

    A report holds its whole tree, so this is for trees of constraints, not for data. Each level is read once.
    """
    depth = cut(nodes.join(lifted(nodes, F.lit(False)).select("node", "depth"), "node"), "depths")
    deepest = depth.agg(F.max("depth").alias("d")).first().d
    folded: DataFrame | None = None
    for d in range(int(deepest) if deepest is not None else -1, -1, -1):
        rows = depth.where(F.col("depth") == d)
        if folded is None:
            kids = None
        else:
            kids = folded.groupBy(F.col("parent").alias("node")).agg(
                F.sum("n_nodes").alias("k_nodes"), F.sum("n_fail").alias("k_fail"), F.sort_array(F.collect_list(F.struct("name", "report"))).alias("parts"))
        fail = (F.coalesce("status", F.lit("")) == "fail").cast("long")
        j = rows if kids is None else rows.join(kids, "node", "left")
        zero = F.lit(0).cast("long")
        k_nodes, k_fail = (zero, zero) if kids is None else (F.coalesce("k_nodes", zero), F.coalesce("k_fail", zero))
        inner = F.lit("") if kids is None else F.coalesce(F.array_join(F.transform("parts", lambda p: p.report), ","), F.lit(""))
        own = F.to_json(F.struct(F.col("name"), F.coalesce("status", F.lit("unchecked")).alias("status"), (k_nodes + 1).alias("n_nodes"), (k_fail + fail).alias("n_fail")))
        report = F.concat(F.regexp_replace(own, r"\}$", ""), F.lit(',"children":['), inner, F.lit("]}"))
        folded = cut(j.select("node", "parent", "name", (k_nodes + 1).alias("n_nodes"), (k_fail + fail).alias("n_fail"), report.alias("report")), "fold")
        if d == 0:
            return folded.select(F.col("node").alias("root"), "n_nodes", "n_fail", "report")
    return nodes.sparkSession.createDataFrame([], "root string, n_nodes long, n_fail long, report string")
