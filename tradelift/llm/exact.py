"""Exact duplicates by deterministic block naming.

A normalised text (A-Z in lower case, UTF-8) is cut into blocks of fixed size. Blocks are sorted, and each distinct block
gets an integer name; then adjacent names are paired and the distinct pairs named in turn, until every
document has one name. Documents are equal if they have as many blocks and the same name: names stand for whole
contents, so nothing rests on a hash. A document with a block that occurs nowhere else has its identity at
once and takes no part in the pairing.

The text is shuffled once. Blocks repeated very often are dealt out by an extra number and their names unified
afterwards; pairs are named from their distinct rows and joined back, which the skew join can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tradelift.llm.common import cut, fresh, partitions

BLOCK = 1024
#: Blocks of a batch leave Python together; about this many bytes.
AT_ONCE = 8 << 20


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def _blocks(size: int):
    for_each = lambda b: [b[i:i + size] for i in range(0, len(b), size)] or [b""]

    def run(docs, texts):
        for doc, text in zip(docs, texts):
            b = normalised(text)
            yield doc, hashlib.sha256(b).digest(), for_each(b)
    return run


def _counted(size: int):
    split = _blocks(size)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"h": np.fromiter((xxhash.xxh64_intdigest(x) for _, _, bs in split(pdf.doc_id, pdf.text) for x in bs), np.uint64).view(np.int64)})
    return run


def _dealt(size: int, hot: frozenset, salts: int):
    split, names = _blocks(size), ["doc_id", "sha", "blocks", "pos", "salt", "block"]

    def out(rows):
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    def run(batches):
        for pdf in batches:
            rows, held = [], 0
            for doc, sha, bs in split(pdf.doc_id, pdf.text):
                for i, x in enumerate(bs):
                    salt = 0
                    if np.uint64(xxhash.xxh64_intdigest(x)).view(np.int64) in hot:
                        salt = 1 + xxhash.xxh64_intdigest(f"{doc} {i}") % salts
                    rows.append((doc, sha, len(bs), i, salt, x))
                    held += len(x)
                if held > AT_ONCE:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)
    return run


def _named(batches):
    """Names of blocks in a sorted partition; a batch waits for the next one's first block. `block` is
    given once for each name of a block that was dealt out by salt."""
    top, run, before, waiting = TaskContext.get().partitionId() << 40, -1, None, None

    def out(batch, run, before, after):
        block = batch.column("block")
        same = np.zeros(len(block) + 1, bool)  # row i equals the row before it
        if len(block) > 1:
            same[1:-1] = pc.equal(block[1:], block[:-1]).to_numpy(zero_copy_only=False)
        same[0], same[-1] = before is not None and block[0].as_py() == before, after is not None and block[-1].as_py() == after
        first = ~same[:-1]
        names = run + np.cumsum(first)
        salted = batch.column("salt").to_numpy() > 0
        alone = first & ~same[1:] & ~salted
        shown = pc.if_else(pa.array(first & salted), block, pa.scalar(None, block.type))
        columns = [batch.column(n) for n in ("doc_id", "sha", "blocks", "pos")] + [pa.array(top + names), pa.array(alone), pa.array(salted), shown]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "blocks", "pos", "name", "alone", "salted", "block"]), int(names[-1]), block[-1].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting is not None:
            made, run, before = out(waiting, run, before, batch.column("block")[0].as_py())
            yield made
        waiting = batch
    if waiting is not None:
        yield out(waiting, run, before, None)[0]


def _block_names(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, sha, blocks, pos, name and alone for every block of every document."""
    spark = docs.sparkSession
    n = partitions(spark)
    counts = docs.mapInPandas(_counted(size), "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n >= 256")
    # every block that fills more than a quarter of a partition is among the 4 n most frequent
    hot = frozenset(r.h for r in counts.orderBy(F.desc("n"), "h").limit(4 * n).collect())
    dealt = docs.mapInPandas(_dealt(size, hot, n), "doc_id bigint, sha binary, blocks int, pos int, salt int, block binary")
    named = cut(dealt.repartition(n, "block", "salt").sortWithinPartitions("block").mapInArrow(
        _named, "doc_id bigint, sha binary, blocks int, pos int, name bigint, alone boolean, salted boolean, block binary"))
    plain = named.drop("block")
    if not hot:
        return plain.drop("salted")
    shown = named.where("block is not null").select("block", "name")
    one = shown.groupBy("block").agg(F.min("name").alias("to"))
    alias = cut(shown.join(one, "block").select("name", "to").distinct())
    # a partition may hold unsalted rows of such a block in the same run, so every row asks
    joined = plain.join(alias, "name", "left").withColumn("name", F.coalesce("to", "name"))
    return joined.select("doc_id", "sha", "blocks", "pos", "name", "alone")


def _identities(docs: DataFrame) -> DataFrame:
    """Names of documents (doc_id, sha, blocks, mult, names), one name in `names` when it ends."""
    while True:
        if not docs.where(F.size("names") > 1).limit(1).count():
            return docs
        steps = F.transform(F.sequence(F.lit(0), F.size("names") - 1, F.lit(2)),
                            lambda i: F.struct(i.alias("i"), F.get("names", i).alias("a"), F.coalesce(F.get("names", i + 1), F.lit(-1)).alias("b")))
        longer = docs.where(F.size("names") > 1)
        rows = cut(longer.select("doc_id", "sha", "blocks", "mult", F.explode(steps).alias("p")).select("doc_id", "sha", "blocks", "mult", "p.*"))
        pairs = cut(rows.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()))
        again = rows.join(pairs, ["a", "b"]).groupBy("doc_id", "sha", "blocks", "mult").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("names"))
        docs = cut(docs.where(F.size("names") == 1).unionByName(again))


def groups(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of `docs`.

    Null texts count as empty, and empty texts equal each other. keep_id is the largest doc_id of the
    group; nulls are smaller than any id, and keep_id is null where all are. Rows alike in id and text
    are counted apiece, and one of them is kept. Other columns are not read."""
    named = _block_names(docs.select("doc_id", "text"), size)
    whole = cut(named.groupBy("doc_id", "sha", "blocks").agg(
        F.max("alone").alias("alone"), F.sum((F.col("pos") == 0).cast("long")).alias("mult"),
        F.transform(F.array_sort(F.collect_set(F.struct("pos", "name"))), lambda x: x["name"]).alias("names")))
    single = whole.where("alone").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "mult")
    ends = _identities(whole.where("not alone").drop("alone")).select("doc_id", "sha", "blocks", "mult", F.get("names", F.lit(0)).alias("name"))
    ends = cut(ends)
    one = cut(ends.groupBy("blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("mult").alias("group_size")))
    many = ends.join(one, ["blocks", "name"]).select("doc_id", "sha", "keep_id", "group_size", "mult")
    rows = single.unionByName(many).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mult"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


@F.pandas_udf(T.StringType())
def text_sha256(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashlib.sha256(normalised(t)).hexdigest())


def distinct(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay: one of each text. Rows are numbered once and those that go are found by number, so whole rows are
    not sorted; where few rows go, they are not shuffled either."""
    row, sha, key, text = fresh(docs, "__row", "__sha", "__key", "__text")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = groups(numbered, size).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(text))
    marked = cut(numbered.select(row, "doc_id", text_sha256("text").alias(sha)))
    stay = marked.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(text)), "left_semi").groupBy("doc_id", sha).agg(F.min(row).alias(row))
    gone = cut(marked.select(row).join(stay.select(row), row, "left_anti"))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
