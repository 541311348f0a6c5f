"""Fuzzy line deduplication.

Lines are normalised (A-Z in lower case, digits as 0, other ASCII marks as spaces, one space between words) and equal ones
collapse to a row by a 128-bit hash and the line's length. A distinct line's SimHash has 64 bits from its words
and word pairs. Two lines are candidates if at most three bits differ: of five blocks two then agree, so the lines are
joined on each of the ten pairs of blocks. Candidates alone have their text read again, meet by block pair, and
link if their edit similarity is 0.8 or more, 1 - distance / longer length. Within a block pair a line is compared
only with lines that it is not yet connected to. Of each connected group the first occurrence, by document
id and line number, stays; empty lines always stay.
"""

from __future__ import annotations

from itertools import chain, combinations
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tradelift.llm.common import components, cut, forest, fresh, partitions, shared_path

RADIUS, SIMILAR = 3, 0.8
#: First bit and width of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_PAIRS = list(combinations(range(5), 2))
#: Words whose bits are counted at once.
AT_ONCE = 1 << 18
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


#: A byte's bits, each in a byte of its own, the highest first in memory.
_SPREAD = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).view(np.uint64).ravel()


def normal_words(line: str) -> list[bytes]:
    return line.encode("utf-8", "replace").translate(_NORMAL).split()


def normal(line: str) -> bytes:
    return b" ".join(normal_words(line))


def _bit_counts(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set among the consecutive keys of every line. 255 keys at most are summed in bytes."""
    parts = -(-size // 255)
    line = np.repeat(np.arange(len(size)), parts)
    within = np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(np.cumsum(size) - size, parts) + 255 * within
    counts = np.zeros((len(size), 64), np.int64)
    if len(first):
        lanes = _SPREAD[keys.astype(">u8").view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, first, axis=0).view(np.uint8)
        own = np.flatnonzero(parts)
        counts[own] = np.add.reduceat(sums, np.flatnonzero(within == 0), axis=0, dtype=np.int64) if (parts > 1).any() else sums
    return counts


def simhashes(words: list[list[bytes]]) -> np.ndarray:
    """Fingerprints of lines given as words: majority bits of the hashes of words and neighbouring words; zero for no words."""
    out, at = np.zeros(len(words), np.uint64), 0
    while at < len(words):
        end, held = at, 0
        while end < len(words) and (held < AT_ONCE or end == at):
            held += len(words[end])
            end += 1
        size = np.array([len(w) for w in words[at:end]])
        h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words[at:end])), np.uint64, int(size.sum()))
        of = np.repeat(np.arange(end - at), size)
        with np.errstate(over="ignore"):
            pair = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F))[of[:-1] == of[1:]]
        pairs = np.maximum(size - 1, 0)
        counts = _bit_counts(h, size) + _bit_counts(pair, pairs)
        out[at:end] = np.packbits(counts * 2 > (size + pairs)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
        at = end
    return out


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance by bit vectors, or `most` + 1 as soon as it must exceed `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for j, c in enumerate(b):
        eq = at.get(c, 0)
        vertical, horizontal = eq | down, ((eq & up) + up ^ up) | eq
        more, less = down | ~(horizontal | up) & full, up & horizontal
        score += bool(more & top) - bool(less & top)
        if score - (len(b) - j - 1) > most:
            return most + 1
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(vertical | more) & full, more & vertical
    return score


def _few_changes(a: str, b: str, most: int) -> bool:
    """Whether replacing words in place shows that the distance is `most` at most; no answer otherwise."""
    x, y = a.split(" "), b.split(" ")
    return len(x) == len(y) and sum(max(len(u), len(v)) for u, v in zip(x, y) if u != v) <= most


def _similar(a: str, b: str) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - SIMILAR) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # what both begin or end with takes no part in the distance
    start = len(commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[:len(a) - end], b[:len(b) - end]
    return max(len(a), len(b)) <= most or _few_changes(a, b, most) or distance(a, b, most) <= most


def _lines(batches):
    for pdf in batches:
        docs, names, numbers, words = [], [], [], []
        for doc, name, text in zip(pdf.doc_id, pdf.name, pdf.text):
            if pd.isna(doc):
                continue
            for i, line in enumerate((text or "").split("\n")):
                if w := normal_words(line):
                    docs.append(doc), names.append(name), numbers.append(i), words.append(w)
        lines = list(map(b" ".join, words))
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)
        yield pd.DataFrame({"doc_id": np.array(docs, np.int64), "name": np.array(names, np.int64), "line": np.array(numbers, np.int32), "h1": halves[:, 0], "h2": halves[:, 1],
                            "size": np.array(list(map(len, lines)), np.int32), "sim": simhashes(words).view(np.int64)})


def _keys(sim: Column) -> Column:
    """The ten pairs of blocks: number of the pair above the values of its blocks."""
    part = [F.shiftrightunsigned(sim, at).bitwiseAND((1 << width) - 1) for at, width in BLOCKS]
    return F.array(*[F.shiftleft(F.lit(k).cast("long"), 26) + F.shiftleft(part[i], 13) + part[j] for k, (i, j) in enumerate(_PAIRS)])


#: For every pair of blocks the masks of the earlier blocks, which must differ.
_EARLIER = [[np.uint64((1 << BLOCKS[k][1]) - 1 << BLOCKS[k][0]) for k in range(pair[1]) if k not in pair] for pair in _PAIRS]


def _owned(x, y, key: int):
    """Whether fingerprints (integers or unsigned arrays) lie within the radius and the key's blocks are the first two that agree;
    a candidate pair meets under several keys and is looked at under one."""
    d = x ^ y
    near = np.bitwise_count(d) <= RADIUS
    for mask in _EARLIER[key >> 26]:
        near &= d & mask != 0
    return near


#: Rows of a key up to which the rows of a batch are compared side by side, all keys at once.
SMALL = 32


def _near(batches):
    """Of rows sorted by key, those with another one of the key that is theirs to look at. Most keys have few rows, so whole
    batches are cut where the key changes and the last run waits for the next batch. Rows of small keys are compared
    with the next row, the one after and so on; larger keys apart."""
    def found(key, sims):
        out = []
        for i in range(0, len(sims), 256):
            near = _owned(sims[i:i + 256, None], sims[None, :], key)
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
            out.append(near.any(1))
        return np.concatenate(out)

    held = None
    for batch in chain(batches, [None]):
        own = None if batch is None else tuple(batch.column(c).to_numpy() for c in ("key", "id", "sim"))
        now = held if own is None else own if held is None else tuple(map(np.concatenate, zip(held, own)))
        if now is None or not len(now[0]):
            continue
        first = np.flatnonzero(np.append(True, now[0][1:] != now[0][:-1]))
        end = first[-1] if own is not None else len(now[0])
        held = tuple(c[end:] for c in now)
        key, ids, sims = (c[:end] for c in now)
        sims = sims.view(np.uint64)
        first = first[first < end]
        size = np.diff(np.append(first, end))
        hit, left = np.zeros(end, bool), np.repeat(np.where(size <= SMALL, size, 0), size) - (np.arange(end) - np.repeat(first, size))
        for step in range(1, SMALL):
            at = np.flatnonzero(left > step)
            if not len(at):
                break
            at = at[np.bitwise_count(sims[at] ^ sims[at + step]) <= RADIUS]
            kind = key[at] >> 26
            for k in np.unique(kind).tolist():
                i = at[kind == k]
                i = i[_owned(sims[i], sims[i + step], k << 26)]
                hit[i] = hit[i + step] = True
        for i in np.flatnonzero(size > SMALL):
            part = slice(first[i], first[i] + size[i])
            hit[part] = found(int(key[first[i]]), sims[part])
        yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(ids[hit])], ["key", "id"])


def _texts(batches):
    """The wanted lines of each document, normalised."""
    for pdf in batches:
        rows = []
        for text, wanted in zip(pdf.text, pdf.wanted):
            lines = (text or "").split("\n")
            rows += [(w["id"], normal(lines[w["line"]]).decode("utf-8")) for w in wanted]
        yield pd.DataFrame(rows, columns=["id", "words"])


def _linked(batches):
    """Links between rows of a key whose lines are similar. One link into a group of linked rows is enough, so the
    search of a group ends at the first."""
    key, groups = None, []
    for pdf in batches:
        out = []
        for k, i, sim, words in zip(pdf.key.tolist(), pdf.id.tolist(), pdf.sim.to_numpy().view(np.uint64), pdf.words):
            if k != key:
                key, groups = k, []
            own, rest = [(i, sim, words)], []
            for group in groups:
                hit = next((j for j, other, text in group if _owned(sim, other, k) and _similar(words, text)), None)
                if hit is None:
                    rest.append(group)
                else:
                    out.append((i, hit))
                    own = group + own if len(group) >= len(own) else own + group
            groups = [*rest, own]
        yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("name"), "text")


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, name (of the text, a 64-bit hash), line (from 0), class_id and kept of every line of `docs` that is not empty when normalised.

    Lines end at a line feed. A null or empty text has no such line; rows with a null doc_id have none here, so they
    lose nothing. Rows that repeat a doc_id and text count apart but are kept or not together; texts that share a
    doc_id are told apart by name."""
    spark = docs.sparkSession
    n = partitions(spark)
    path = shared_path(spark, "lines")
    _named(docs).mapInPandas(_lines, "doc_id bigint, name bigint, line int, h1 bigint, h2 bigint, size int, sim bigint").write.parquet(path)
    lines = spark.read.parquet(path)
    content = ["h1", "h2", "size"]
    distinct = cut(lines.groupBy(*content).agg(F.min(F.struct("doc_id", "line", "name")).alias("first"), F.min("sim").alias("sim")).withColumn("id", F.monotonically_increasing_id()))
    dealt = distinct.select(F.explode(_keys(F.col("sim"))).alias("key"), "id", "sim")
    near = cut(dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_near, "key bigint, id bigint"))
    wanted = near.select("id").distinct().join(distinct.select("id", "first"), "id").select("first.doc_id", "first.name", F.struct("first.line", "id").alias("w"))
    wanted = wanted.groupBy("doc_id", "name").agg(F.collect_list("w").alias("wanted"))
    once = _named(docs).join(wanted, ["doc_id", "name"])
    texts = once.mapInPandas(_texts, "id bigint, words string").join(distinct.select("id", "sim"), "id")
    met = near.join(texts, "id").repartition(n, "key").sortWithinPartitions("key", "id")
    classes = components(forest(met.mapInPandas(_linked, "a bigint, b bigint")))
    named = distinct.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("class_id", F.coalesce("component", "id"))
    keep = cut(named.groupBy("class_id").agg(F.min("first").alias("keep")))
    named = cut(named.select(*content, "class_id").join(keep, "class_id"))
    out = lines.select("doc_id", "name", "line", *content).join(named, content)
    return out.select("doc_id", "name", "line", "class_id", (F.struct("doc_id", "line", "name") == F.col("keep")).alias("kept"))


def _decided(docs: DataFrame) -> DataFrame:
    rows = marked(docs).groupBy("doc_id", "name").agg(F.count("*").alias("lines"), F.array_sort(F.collect_set(F.when(~F.col("kept"), F.struct("line", "class_id")))).alias("gone"))
    return rows.select("doc_id", "name", "lines", F.transform("gone", lambda x: x["line"]).alias("dropped"), F.transform("gone", lambda x: x["class_id"]).alias("classes"))


def decided(docs: DataFrame) -> DataFrame:
    """doc_id, lines (how many), dropped (sorted numbers of the lines that go) and classes (the group of each, in the same order) of every
    document with an id that has lines; an id with several texts has a row for each."""
    return _decided(docs).drop("name")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with `text` less the dropped lines; a null text and a row with a null doc_id stay as they are."""
    own, name, numbers = fresh(docs, "__id", "__name", "__gone")
    gone = _decided(docs).where(F.size("dropped") > 0).select(F.col("doc_id").alias(own), F.col("name").alias(name), F.col("dropped").alias(numbers))
    split = F.split(F.col("text"), "\n")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col(numbers), i)), "\n")
    out = docs.join(gone, (docs["doc_id"] == F.col(own)) & (F.xxhash64(docs["text"]) == F.col(name)), "left")
    return out.select(*[F.when(F.col(numbers).isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c) for c in docs.columns])
