"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt into blocks and queries into groups; a cell is a block and a group. In a block each component has a sorted list, and
a query reads all lists side by side from the end that its own component's sign makes best. What has been read gives every
candidate a lower bound, unread components counting as the worst of their list, and an upper bound, unread ones counting as the last value
read. A candidate whose upper bound is below the bar, which is k-th best lower bound so far, is ruled out; reading goes on, by a twentieth of the
lists at a time, until few are left or the lists end. Only those get their final scores.

A query first asks one block, and its k-th best score there is the bar that it brings to all others. Bounds that
sum tens of components rule nothing out before about half of a list is read, so reading starts there. All bounds of
a group are two matrix products: a component read counts with its value, one not read with the worst or the last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelift.llm.common import cut, partitions

#: Candidates of a block and queries of a group at most, which bound the memory of a task.
BLOCK, GROUP = 4096, 256
#: Depths of reading as parts of the lists.
DEPTHS = tuple(x / 20 for x in range(10, 20))
#: Integers beyond this lose digits as doubles; bounds are then widened by a part in 2**50 and scores computed with whole numbers.
EXACT = 1 << 53


class Lists:
    """Sorted lists of the components of one block's vectors (rows of `v`, integers)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        #: How many candidates were scored after reading, and how many there were to rule out.
        self.scored = self.asked = 0
        n = len(ids)
        order = np.argsort(v, axis=0, kind="stable")
        self.place = np.empty(v.shape, np.int32)  # of each component in its list, smallest value first
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], 0)
        self.sorted = np.take_along_axis(v, order, 0)

    def _bounds(self, depth: int, q: np.ndarray, rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of rows for queries (columns of `q`) once `depth` values of each list are read."""
        n, up, down = len(self.ids), np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
        place, v = self.place[rows], self.v[rows]
        high, low = place >= n - depth, place < depth  # read from the upper, from the lower end
        s = self.sorted
        lower = np.where(high, v, s[0]).astype(float) @ up + np.where(low, v, s[-1]).astype(float) @ down
        upper = np.where(high, v, s[n - depth]).astype(float) @ up + np.where(low, v, s[depth - 1]).astype(float) @ down
        return lower, upper

    def best(self, own: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray | None = None):
        """(ids, scores) for each query (row of `q`): its k best, ties to smaller ids; rows with its id in `own` take no part. Of those below `bar`, a score that k
        others are known to reach, some may be missing."""
        n, many = len(self.ids), len(q)
        bar = np.full(many, -np.inf) if bar is None else bar.astype(float)
        other = self.ids[:, None] != own[None, :]
        most = np.abs(self.v).max(initial=0) * float(np.abs(q).max(initial=0)) * max(1, q.shape[1])
        slack = 0.0 if most < EXACT else most * 2.0 ** -50
        rest = [np.flatnonzero(other[:, i]) for i in range(many)]
        self.asked += sum(map(len, rest))
        whole = True
        for part in DEPTHS:
            depth = min(n, max(1, int(part * n)))
            todo = [i for i in range(many) if len(rest[i]) > 4 * k]
            if not todo or depth >= n:
                break
            if whole:  # as long as nearly all are left, for all queries at once
                lower, upper = self._bounds(depth, q[todo].T, slice(None))
            for c, i in enumerate(todo):
                low, high = (lower[rest[i], c], upper[rest[i], c]) if whole else (x[:, 0] for x in self._bounds(depth, q[i:i + 1].T, rest[i]))
                bar[i] = max(bar[i], np.partition(low, -k)[-k] - slack)
                rest[i] = rest[i][high + slack >= bar[i]]
            whole = sum(len(rest[i]) for i in todo) > 0.25 * n * len(todo)
        out = []
        for i in range(many):
            self.scored += len(rest[i])
            score = _products(self.v[rest[i]], q[i], most)
            order = np.lexsort((self.ids[rest[i]], -score))[:k]
            out.append((self.ids[rest[i]][order], score[order]))
        return out


def _products(v: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Inner products as 64-bit integers; one that needs more is an error."""
    if most < EXACT:
        return (v.astype(float) @ q.astype(float)).astype(np.int64)
    score = v.astype(object) @ q.astype(object)
    if len(score) and max(map(abs, score)) >= 1 << 63:
        raise OverflowError("a score needs more than 64 bits")
    return score.astype(np.int64)


def _searched(k: int):
    """Candidates (kind 0) and queries (kind 1, with bar) sorted by cell; candidates of a cell come first."""
    def run(batches):
        cell, ids, rows, asked, lists = None, [], [], [], None

        def answers():
            nonlocal lists
            if not ids or not asked:
                asked.clear()
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
            lists = lists or Lists(np.array(ids, np.int64), np.array(rows, np.int64))
            own, q, bar = (np.array(x) for x in zip(*asked))
            found = lists.best(own.astype(np.int64), q.astype(np.int64), k, np.where(np.isnan(bar), -np.inf, bar))
            asked.clear()
            size = [len(f[0]) for f in found]
            return pd.DataFrame({"query_id": np.repeat(own, size), "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

        for pdf in batches:
            out = []
            for c, kind, i, v, bar in zip(zip(pdf.dims, pdf.block, pdf.part), pdf.kind, pdf.vec_id, pdf.v, pdf.bar):
                if c != cell:
                    out.append(answers())
                    cell, ids, rows, lists = c, [], [], None
                if kind == 0:
                    ids.append(i)
                    rows.append(v)
                else:
                    asked.append((i, v, bar))
                    if len(asked) >= GROUP:
                        out.append(answers())
            if out:
                yield pd.concat(out)
        yield answers()
    return run


def whole(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * component) of a vector; null if the vector, or any component, is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of `vectors` (vec_id, v array<bigint>) for each row of `queries`
    (the same columns), by inner product, ties to smaller ids; fewer where there are fewer.

    Rows with a null id or vector take no part, a query meets only vectors of its own length, and rows with the
    query's own id are left out. Repeated queries are answered once; repeated candidates count apiece. A score
    that needs more than 64 bits is an error."""
    shape = lambda df: df.select("vec_id", "v").where("vec_id is not null and v is not null").withColumn("dims", F.size("v"))
    rows, asked = shape(vectors), shape(queries).distinct()
    n = partitions(vectors.sparkSession)
    blocks = max(1, -(-rows.count() // BLOCK))
    asked = cut(asked.withColumn("own", F.pmod(F.xxhash64("vec_id", "v", F.lit(7)), F.lit(blocks)).cast("int")))
    many = asked.count()

    def searched(pairs: DataFrame, parts: int) -> DataFrame:
        """Best of the queries `pairs` (vec_id, v, dims, block, bar) in their blocks. A block goes to as many cells as there are parts of the queries."""
        part = lambda df: df.withColumn("part", F.pmod(F.xxhash64("vec_id", "v", F.lit(9)), F.lit(parts)).cast("int")).withColumn("kind", F.lit(1))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("bar", F.lit(None).cast("double"))
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(0))
        met = dealt.unionByName(part(pairs)).withColumn("cell", F.col("block") * parts + F.col("part"))
        # cells of about equal size go to tasks of their own, as even as ranges make them
        met = met.repartitionByRange(max(n, blocks * parts), "cell", "dims").sortWithinPartitions("dims", "block", "part", "kind").drop("cell")
        return cut(met.mapInPandas(_searched(k), "query_id bigint, vec_id bigint, score bigint"))

    first = searched(asked.select("vec_id", "v", "dims", F.col("own").alias("block"), F.lit(None).cast("double").alias("bar")), 1)
    best = first.groupBy("query_id").agg(F.array_sort(F.collect_list("score")).alias("s"))
    bars = best.where(F.size("s") >= k).select(F.col("query_id").alias("vec_id"), F.element_at("s", -k).cast("double").alias("bar"))
    # an id that stands for several vectors has no bar of its own
    once = asked.groupBy("vec_id").agg(F.count("*").alias("times")).where("times = 1").select("vec_id")
    barred = asked.join(bars.join(once, "vec_id"), "vec_id", "left")
    others = barred.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <> own").select("vec_id", "v", "dims", "block", "bar")
    found = first if blocks == 1 else first.unionByName(searched(others, max(1, -(-many // (4 * GROUP)), min(-(-3 * n // blocks), many // 64))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
