"""SimHash near-duplicates with BK-trees.

A fingerprint holds the majority bits of the hashes of a text's word shingles. Distinct fingerprints are
nodes; two link if at most `radius` bits differ; a class is a connected component.

Fingerprints meet in shards: every fingerprint goes to one shard for each table, a table being a choice of
bits whose values name the shard. With 64 bits and radius 2 the six tables take two of four 16-bit blocks,
and two differing bits leave at least two blocks alike, so no link is lost. A shard of more than
`shard_size` fingerprints is dealt again by the same rule over the bits that its name leaves open. Each shard
grows a BK-tree whose children hang at their Hamming distance from the parent, and a search follows
only the edges within the radius. The trees are built where the shuffle puts the shards instead of being
broadcast, because together they grow with the corpus. Each shard gives only the links that join
two of its groups, so a dense shard of n fingerprints gives fewer than n rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tradelift.llm import similar
from tradelift.llm.common import Groups, components, cut, forest, fresh, partitions

SEED = 42
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Scheme:
    """words: of a shingle; bits: of a fingerprint, 64 for each seed; tables, finer: bit positions that name a
    shard, and those used again for shards above `shard_size`."""
    words: int
    bits: int
    radius: int
    tables: tuple
    finer: tuple
    shard_size: int = 2000


def _pairs(blocks: list[range]) -> list[tuple[int, ...]]:
    return [(*a, *b) for a, b in combinations(blocks, 2)]


def _exact() -> Scheme:
    first = _pairs([range(16 * i, 16 * i + 16) for i in range(4)])
    finer = []
    for t in first:
        rest = [b for b in range(64) if b not in t]
        finer.append(tuple(_pairs([rest[8 * i:8 * i + 8] for i in range(4)])))
    return Scheme(3, 64, 2, tuple(first), tuple(finer))


#: Three-word shingles, 64 bits, at most two differing: complete.
EXACT = _exact()


def fingerprint(text: str | None, words: int = 3, bits: int = 64) -> bytes:
    """Big-endian bytes; all zero for a text without words."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return bytes(bits // 8)
    joined, ends, at = b" ".join(w), [], 0
    starts = []
    for x in w:
        starts.append(at)
        at += len(x)
        ends.append(at)
        at += 1
    spans = list(zip(starts, ends[words - 1:])) if len(w) >= words else [(0, len(joined))]
    n, counts = len(spans), np.zeros(bits, np.int64)
    for i in range(0, n, AT_ONCE):
        part = [joined[a:b] for a, b in spans[i:i + AT_ONCE]]
        for k in range(bits // 64):
            h = np.fromiter((xxhash.xxh64_intdigest(s, SEED + k) for s in part), ">u8", len(part))
            rows = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
            # sums in bytes are safe over 255 rows at a time
            for j in range(0, len(rows), 255):
                counts[64 * k:64 * k + 64] += rows[j:j + 255].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > n).tobytes()


class Tree:
    """A BK-tree over integers."""

    def __init__(self):
        self.root = None

    def add(self, value: int, name) -> None:
        if self.root is None:
            self.root = (value, name, {})
            return
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            if d not in node[2]:
                node[2][d] = (value, name, {})
                return
            node = node[2][d]

    def near(self, value: int, radius: int):
        """Names within the radius, one after another."""
        todo = [self.root] if self.root else []
        while todo:
            v, name, children = todo.pop()
            d = (value ^ v).bit_count()
            if d <= radius:
                yield name
            for edge in range(d - radius, d + radius + 1):
                if edge in children:
                    todo.append(children[edge])


class Ball:
    """The tree of one dense group, its first value and how far the others lie from that."""

    def __init__(self, value: int, name):
        self.centre, self.cover, self.tree = value, 0, Tree()
        self.tree.add(value, name)

    def add(self, value: int, name) -> None:
        self.cover = max(self.cover, (value ^ self.centre).bit_count())
        self.tree.add(value, name)

    def any(self, value: int, radius: int):
        """Some name within the radius, or None. A value outside the cover and the radius meets nobody."""
        if (value ^ self.centre).bit_count() > self.cover + radius:
            return None
        return next(self.tree.near(value, radius), None)


#: Members from which a group grows a tree of its own.
DENSE = 8


def _links(group: list[tuple[int, int]], radius: int):
    """Joining links (a, b) of one shard's (node, fingerprint) rows.

    Once a group has DENSE members, its later members go to a tree of the group's own. One link into a group is
    enough, so the search of such a tree ends at the first hit, and a dense shard costs little more than its rows."""
    loose, balls, size, groups = Tree(), {}, {}, Groups()
    find = groups.find

    def join(a, b):
        low, high = sorted((find(a), find(b)))
        if not groups.join(low, high):
            return False
        size[low] += size.pop(high)
        if high in balls:
            balls.setdefault(low, []).extend(balls.pop(high))
        return True

    for node, value in group:
        size[node] = 1
        for other in loose.near(value, radius):
            if join(node, other):
                yield node, other
        for root in list(balls):
            if root in balls and find(node) != root:
                for ball in balls[root]:
                    other = ball.any(value, radius)
                    if other is not None:
                        join(node, other)
                        yield node, other
                        break
        root = find(node)
        if root in balls:
            balls[root][0].add(value, node)
        elif size[root] >= DENSE:
            balls[root] = [Ball(value, node)]
        else:
            loose.add(value, node)


def _fingerprints(words: int, bits: int):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "fp": [fingerprint(t, words, bits) for t in pdf.text]})
    return run


def _bits(fps) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)


def _dealt(tables, finer=(), large: frozenset = frozenset()):
    """Every node once for each table, and where that names a large shard, once for each of the finer tables instead.
    Nodes and fingerprints stay Arrow columns; only keys are made."""
    def keyed(key: np.ndarray, batch, rows=None):
        n = len(key)
        ends = np.arange(n + 1, dtype=np.int32) * key.shape[1]
        column = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(key).tobytes())])
        node, fp = (batch.column(c) if rows is None else batch.column(c).take(pa.array(rows)) for c in ("node", "fp"))
        return pa.RecordBatch.from_arrays([column, node, fp], ["key", "node", "fp"])

    def named(bit, i, table, head=None):
        parts = [np.full((len(bit), 1), i, np.uint8), np.packbits(bit[:, list(table)], axis=1)]
        return np.hstack(parts if head is None else [head, *parts])

    def run(batches):
        for batch in batches:
            bit = _bits(batch.column("fp").to_pylist()) if batch.num_rows else None
            for i, t in enumerate(tables if batch.num_rows else ()):
                key = named(bit, i, t)
                width, flat = key.shape[1], key.tobytes()
                hot = np.fromiter((flat[j:j + width] in large for j in range(0, len(flat), width)), bool, len(key)) if large else np.zeros(len(key), bool)
                if not hot.any():
                    yield keyed(key, batch)
                    continue
                yield keyed(key[~hot], batch, np.flatnonzero(~hot))
                for j, again in enumerate(finer[i]):
                    yield keyed(named(bit[hot], j, again, key[hot]), batch, np.flatnonzero(hot))
    return run


def _dealt_again(finer):
    """Rows marked as large once for each of the finer tables, the others as they are."""
    def run(batches):
        for pdf in batches:
            yield pdf.loc[~pdf.large, ["key", "node", "fp"]]
            large = pdf[pdf.large]
            for i, rows in large.groupby(large.key.map(lambda k: k[0])):
                bit = _bits(rows.fp)
                for j, t in enumerate(finer[i]):
                    part = np.packbits(bit[:, list(t)], axis=1)
                    keys = [k + bytes((j,)) + x.tobytes() for k, x in zip(rows.key, part)]
                    yield pd.DataFrame({"key": keys, "node": rows.node.to_numpy(), "fp": rows.fp.to_numpy()})
    return run


def _searched(radius: int):
    """Links of rows sorted by shard; one shard is held at a time."""
    def run(batches):
        key, group = None, []
        for pdf in batches:
            out = []
            for k, node, fp in zip(pdf.key, pdf.node, pdf.fp):
                if k != key:
                    if len(group) > 1:
                        out += _links(group, radius)
                    key, group = k, []
                group.append((node, int.from_bytes(fp, "big")))
            yield pd.DataFrame(out, columns=["a", "b"])
        if len(group) > 1:
            yield pd.DataFrame(list(_links(group, radius)), columns=["a", "b"])
    return run


#: Names of large shards that every task may hold; more are joined by shuffle.
KNOWN_SHARDS = 100_000


def links(nodes: DataFrame, scheme: Scheme, known_shards: int = KNOWN_SHARDS) -> DataFrame:
    """Links (a, b) that join all `nodes` (node long, fp binary, both distinct) reachable from each other."""
    shape, n = "key binary, node bigint, fp binary", partitions(nodes.sparkSession)
    nodes = nodes.select("node", "fp")
    dealt = nodes.mapInArrow(_dealt(scheme.tables), shape)
    sizes = dealt.select("key").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > scheme.shard_size)
    large = cut(sizes.select("key", F.lit(True).alias("large")))
    if large.limit(known_shards + 1).count() <= known_shards:
        names = frozenset(bytes(r.key) for r in large.select("key").collect())
        shards = nodes.mapInArrow(_dealt(scheme.tables, scheme.finer, names), shape)
    else:
        told = dealt.join(large, "key", "left").select("key", "node", "fp", F.coalesce("large", F.lit(False)).alias("large"))
        shards = told.mapInPandas(_dealt_again(scheme.finer), shape)
    ordered = shards.repartition(n, "key").sortWithinPartitions("key", "node")
    return forest(ordered.mapInPandas(_searched(scheme.radius), "a bigint, b bigint"))


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """doc_id and fp (binary) of every row."""
    return docs.select("doc_id", "text").mapInPandas(_fingerprints(scheme.words, scheme.bits), "doc_id bigint, fp binary")


def classes(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable, for every row of `docs`.

    Null and empty texts and texts without words have the fingerprint zero and are linked like any other. Repeated
    rows stay repeated. Rows with a null doc_id take part, but a class made of them alone has a null
    component_id. Other columns are not read."""
    marked = cut(fingerprints(docs, scheme))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    found = components(links(nodes.select("node", "fp"), scheme))
    named = cut(nodes.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component")))
    ids = cut(named.groupBy("component").agg(F.min("least").alias("component_id")))
    named = cut(named.join(ids, "component").select("fp", "component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def distinct(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """The rows of `docs`, with all columns, that have the smallest doc_id of their class, one for each class of `classes`; rows without an id stay.
    Rows are numbered once, so rows that repeat an id, with equal or other texts, are told apart; the number stands for the id in `classes`."""
    (row,) = fresh(docs, "__row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = cut(classes(numbered.where("doc_id is not null").select(F.col(row).alias("doc_id"), "text"), scheme).select(F.col("doc_id").alias("row"), "component_id"))
    ids = numbered.where("doc_id is not null").select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    # rows alone in their class are most of all and need no minimum
    shared = found.groupBy("component_id").agg(F.count("*").alias("many")).where("many > 1").select("component_id")
    several = cut(found.join(shared, "component_id").join(ids, "row"))
    keep = several.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("keep"))
    gone = several.join(keep, "component_id").where("row <> keep.row").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def representatives(docs: DataFrame) -> DataFrame:
    """See `similar.representatives`: candidates by MinHash, links by the exact similarity of five-word shingles."""
    return similar.representatives(docs)
