"""Near-duplicates by exact Jaccard similarity of five-word shingles.

Distinct shingle sets are nodes. MinHashes only say which nodes are compared: BANDS keys of ROWS minimums each, so a pair at
similarity s meets with a chance of 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8. A pair links if its sets, read again from the texts,
have a similarity of 0.8 or more; classes are the connected components of those links.

Every node is compared with a few drawn ones of its most shared key first, then of all its keys. Nodes that are then connected need no more comparisons among
each other, so a large group of near copies takes a few rounds instead of all its pairs. What is left of a key, the nodes
outside its largest component against all others, is compared in full; no key is cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tradelift.llm.common import components, cut, forest, fresh

WORDS, BANDS, ROWS = 5, 20, 5
#: The similarity of a link as a fraction.
LEAST = (4, 5)
#: Drawn nodes of a key in each round, rounds at most, and comparisons for each dealt row at which the rest is compared in full.
DRAWN, ROUNDS, FULL = 4, 6, 1
#: Shingles hashed to minimums at once.
AT_ONCE = 1 << 16
_RNG = np.random.default_rng(11)
_XOR, _ODD = (_RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(b) for b in (0, 1))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle, one without words has none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    parts = [b" ".join(w[i:i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))] if w else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts)))


def bands(sets: list[np.ndarray]) -> list[list[int]]:
    """A key for each band of every set. The sets are taken together, AT_ONCE shingles at a time."""
    size = np.array(list(map(len, sets)), np.int64)
    low = np.full((BANDS * ROWS, len(sets)), np.iinfo(np.uint64).max)
    found, of = (np.concatenate(sets), np.repeat(np.arange(len(sets)), size)) if len(sets) else ((), ())
    for i in range(0, len(found), AT_ONCE):
        part, own = found[i:i + AT_ONCE], of[i:i + AT_ONCE]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        own = own[first]
        for k in range(len(low)):
            low[k, own] = np.minimum(low[k, own], np.minimum.reduceat((part ^ _XOR[k]) * _ODD[k], first))
    return [[xxhash.xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(one.reshape(BANDS, ROWS))] for one in np.ascontiguousarray(low.T)]


def _marked(batches):
    for pdf in batches:
        sets = [shingles(t) for t in pdf.text]
        yield pd.DataFrame({"row": pdf.row, "id": pdf.id, "name": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                            "size": np.array(list(map(len, sets)), np.int32), "keys": bands(sets)})


def _sets(batches):
    for pdf in batches:
        yield pd.DataFrame({"node": pdf.node, "found": [shingles(t).view(np.int64) for t in pdf.text]})


def _alike(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes a and b with so many common members are similar enough."""
    return common * sum(LEAST) >= (a + b) * LEAST[0]


def linked(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of the nodes that share a key, from `nodes` (node, row, size, keys) and `texts` (row, text). Every dealt row carries the component
    that its node has so far; a round links components only, so the graph of a round is that of the components left."""
    dealt = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowds = cut(dealt.join(shared, "key").withColumn("component", F.col("node")))
    named = crowds.drop("n")
    used = nodes.join(named.select("node").distinct(), "node").select("node", "row")
    sets = cut(texts.join(used, "row").select("node", "text").mapInPandas(_sets, "node bigint, found array<bigint>"))
    own, other = F.struct("node", "component"), F.struct(F.col("other").alias("node"), F.col("other_component").alias("component"))
    pair = [f(own, other).alias(n) for n, f in (("a", F.least), ("b", F.greatest))]
    fits = (F.col("component") != F.col("other_component")) & _alike(F.least("size", "other_size"), F.col("size"), F.col("other_size"))

    def found(pairs):
        """(component, joined): what the pairs of similar sets join."""
        met = cut(pairs.where(fits).select(*pair).distinct())
        met = met.join(sets.select(F.col("node").alias("na"), F.col("found").alias("fa")), F.col("a.node") == F.col("na"))
        met = met.join(sets.select(F.col("node").alias("nb"), F.col("found").alias("fb")), F.col("b.node") == F.col("nb"))
        links = met.where(_alike(F.size(F.array_intersect("fa", "fb")), F.size("fa"), F.size("fb"))).select(F.col("a.component").alias("a"), F.col("b.component").alias("b"))
        return components(forest(links)).select(F.col("node").alias("component"), F.col("component").alias("joined"))

    def joined(named, found):
        return named.join(found, "component", "left").select("key", "node", "size", F.coalesce("joined", "component").alias("component"))

    # a node first asks the key that most others share, where most of a large group meet
    rest = crowds.groupBy("node").agg(F.max(F.struct("n", "key", "size", "component")).alias("r")).select("r.key", "node", "r.size", "r.component")
    rows = named.count()
    for turn in range(ROUNDS):
        salt = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(DRAWN if turn else 2))
        one = F.struct(F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("component").alias("other_component"))
        drawn = named.groupBy("key", salt.alias("salt")).agg(F.min_by(one, F.xxhash64("node", F.lit(-1 - turn))).alias("o"))
        named = cut(joined(named, found(rest.join(drawn.select("key", "o.*"), "key"))))
        # the first round leaves keys out; after a round on all of them a key of two nodes is done
        parts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
        most = cut(parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("all"), F.max("n").alias("in_most")).where("in_most < all" + " and all > 2" * (turn > 0)))
        left = most.agg(F.sum((F.col("all") - F.col("in_most")) * F.col("all"))).first()[0] or 0
        if not left:
            break
        rest = cut(named.join(most, "key").where("component <> most").select("key", "node", "size", "component"))
        if left <= FULL * rows:
            break
    if left:
        others = named.select("key", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("component").alias("other_component"))
        named = joined(named, found(rest.join(others, "key")))
    return cut(named.select("node", "component").distinct())


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, that have the smallest doc_id of their class, one for each class;
    rows without an id stay. Null and empty texts and texts without words are alike. Rows are numbered once, so rows that repeat an
    id, with equal or other texts, are told apart."""
    (row,) = fresh(docs, "__row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = numbered.where("doc_id is not null").select(F.col(row).alias("row"), F.col("doc_id").alias("id"), "text")
    marked = cut(texts.mapInPandas(_marked, "row bigint, id bigint, name binary, size int, keys array<bigint>"))
    nodes = marked.groupBy("name").agg(F.min(F.struct("id", "row")).alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = linked(nodes.select("node", "first.row", "size", "keys"), texts.select("row", "text"))
    named = nodes.join(found, "node", "left").select("name", "first", F.coalesce("component", "node").alias("component"))
    named = cut(named)
    keep = named.groupBy("component").agg(F.min("first").alias("keep"))
    kept = named.join(keep, "component").select("name", F.col("keep.row").alias("kept_row"))
    gone = marked.select("row", "name").join(kept, "name").where("row <> kept_row").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
