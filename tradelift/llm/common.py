"""What several operators share: reading, lineage cuts, splitting a frame's columns, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of the session, spark.checkpoint.dir. Only a local session may lack
    that setting, as in tests, and gets a temporary folder; a cluster without it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back, so that a lost executor rereads them and no later step
    runs what came before again. Sizes of later plans come from the files; those of a checkpointed frame multiply with
    every join of a loop until the driver can no longer hold the numbers."""
    path = shared_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of `df` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


class Groups:
    """Disjoint sets of hashable items."""

    def __init__(self):
        self.top = {}

    def find(self, x):
        top = self.top
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def join(self, a, b) -> bool:
        """Whether the two were apart until now."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.top[max(a, b)] = min(a, b)
        return True


def _joining(batches):
    groups = Groups()
    for pdf in batches:
        yield pdf[[groups.join(a, b) for a, b in zip(pdf.a.tolist(), pdf.b.tolist())]]


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: of the edges that share a partition by `a`, those that join something."""
    return edges.select("a", "b").repartition(partitions(edges.sparkSession), "a").mapInPandas(_joining, "a bigint, b bigint")


#: Edges of a contracted graph that one task may join to groups; larger graphs are contracted further.
AT_ONCE = 100_000


def _grouped(batches):
    groups = Groups()
    for pdf in batches:
        for a, b in zip(pdf.a.tolist(), pdf.b.tolist()):
            groups.join(a, b)
    nodes = list(groups.top)
    yield pd.DataFrame({"node": nodes, "label": [groups.find(n) for n in nodes]}, dtype=np.int64)


def _step(work: DataFrame, turn: int) -> DataFrame:
    """(node, label) of every node of `work`: the node of least hash among itself and its neighbours, and then that node's own label."""
    both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
    order = lambda n: F.struct(F.xxhash64(n, F.lit(turn)).alias("h"), F.col(n).alias("n"))
    near = both.groupBy("a").agg(F.min(order("b")).alias("near"))
    one = cut(near.select(F.col("a").alias("node"), F.least(order("a"), F.col("near"))["n"].alias("label")))
    two = one.select(F.col("node").alias("label"), F.col("label").alias("far"))
    return cut(one.join(two, "label").select("node", F.col("far").alias("label")))


def components(edges: DataFrame, at_once: int = AT_ONCE, rounds: list | None = None) -> DataFrame:
    """(node, component) for every node of `edges` (a, b long) that has an edge to another: component is the smallest node reachable.

    Each round gives every node a label near by, in an order drawn anew, and puts the labels in place of the nodes;
    loops and repeats go, so the graph shrinks by a part of its nodes in every round, chains too. A graph of at most
    `at_once` edges is joined in one task, which does not change the result. Then the labels are followed back.
    Minimums combine before the shuffle and the joins have a unique side, so a node with very many edges is split
    by the skew join. `rounds`, if given, receives the number of edges at the start of each round. Null ends have no edge."""
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    work = cut(edges.where("a <> b").select(*ends).distinct())
    steps = []
    while many := work.count():
        if rounds is not None:
            rounds.append(many)
        if many <= at_once:
            steps.append(cut(work.repartition(1).mapInPandas(_grouped, "node bigint, label bigint")))
            break
        step = _step(work, len(steps))
        steps.append(step)
        moved = work.join(step.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(step.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        work = cut(moved.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if not steps:
        return work.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps.pop()
    while steps:
        later = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
        found = cut(steps.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label")))
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    return found.join(least, "label").select("node", "component")
