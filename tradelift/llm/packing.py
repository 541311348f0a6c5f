"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

How pieces combine depends on their lengths alone, so a plan is made on the counts of each length, at most `limit`
numbers whatever the corpus. First the reduction fixes small sets that dominate every other
way to fill a sequence with that length: a piece that nothing else fits beside, a pair that fills it
exactly, the best single partner where two never fit, the best two where three never fit. What remains is packed
best-fit decreasing. The plan is a list of runs, each placing `count` pieces of one length, by rank, into
consecutive sequences; the pieces are ranked within their length by Spark in salted groups and look their run up.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tradelift.llm.common import cut, fresh, partitions

LIMIT, END = 4096, 1
#: Distinct words whose ids a worker remembers.
REMEMBERED = 300_000

# The normalizer and splitting pattern for which words can be encoded apart from each other.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same pattern for lower-case text of printable ASCII and Latin-1 letters.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \t\n\r\f\v])")


class Words(dict):
    """Little-endian unsigned 32-bit ids of UTF-8 words, by the tokenizer's own model. Words of printable ASCII and Latin-1
    letters go to the BPE model directly; all others take the tokenizer's whole path."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(text)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _ids(self, word: str):
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        model = self.tokenizer.model
        return [t.id for p in _LATIN.findall(word.lower()) for t in model.tokenize(p if p.isascii() else self.bytes.pre_tokenize_str(p)[0][0])]

    def __missing__(self, word: bytes) -> bytes:
        ids = array("I", self._ids(word.decode("utf-8"))).tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


def _by_words(text: str) -> bool:
    """Whether white space always separates and is dropped, so that words can be encoded apart."""
    j = json.loads(text)
    normal = [x.get("type") for x in (j.get("normalizer") or {}).get("normalizers", [])]
    splits = (j.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (normal == _NORMAL and splits[0].get("pattern", {}).get("Regex") == _PATTERN and splits[0].get("behavior") == "Removed"
            and splits[0].get("invert") and j["model"].get("end_of_word_suffix") == "</w>"
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in j.get("added_tokens", [])))


def _encoder(text: str):
    """A function from a text to its ids as bytes. Words are remembered as long as the Python worker lives."""
    kept = sys.modules.setdefault("_llm_worker_words", types.ModuleType("_llm_worker_words")).__dict__
    name = f"t{zlib.crc32(text.encode())}"
    if name not in kept:
        kept[name] = Words(text)
    words = kept[name]

    def encode(t: str) -> bytes:
        data = t.encode("utf-8")
        # the same ids, with fewer distinct words: A-Z in lower case, and a lone full stop or comma as a word of its own
        if b"<|" not in data:
            data = _STOP.sub(rb" \1", data.lower())
        return b"".join(map(words.__getitem__, data.split()))

    if _by_words(text):
        return encode
    return lambda t: np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def _cut_up(sent, limit: int, end: int, keep_ids: bool):
    def run(batches):
        encode, tail = _encoder(sent.value), np.array([end], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                ids = encode(text or "") + tail
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at:at + 4 * limit]
                    row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if keep_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"doc_id": "Int64"})
    return run


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Every document's ids, then `end`, in pieces of at most `limit`: doc_id, piece, start, length, ids_crc32 and, if asked
    for, ids. A null or empty text is one piece holding `end`. Repeated rows stay repeated; a null doc_id stays null."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    shape = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInPandas(_cut_up(sent, limit, end, keep_ids), shape)


class _Plan:
    """Runs (length, first rank, first sequence, count, offset) and what is still to be placed."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.limit, self.left = limit, {k: v for k, v in counts.items() if v}
        self.sizes = sorted(self.left)
        self.used = dict.fromkeys(counts, 0)
        self.runs, self.sequences = [], 0

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], sequence, count, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            del self.sizes[bisect_left(self.sizes, length)]

    def fix(self, members: list[int], times: int) -> None:
        at = 0
        for m in members:
            self.place(m, times, self.sequences, at)
            at += m
        self.sequences += times

    def largest(self, most: int, but: list[int]) -> int:
        """The largest length up to `most` of which a piece is left beside those of `but`; 0 if none."""
        for i in range(bisect_right(self.sizes, most) - 1, -1, -1):
            if self.left[self.sizes[i]] > but.count(self.sizes[i]):
                return self.sizes[i]
        return 0

    def smallest(self, n: int, but: list[int]) -> list[int]:
        out = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - but.count(s))
            if len(out) == n:
                break
        return out

    def dominating(self, j: int) -> list[int] | None:
        """A set holding `j` that dominates every other feasible one, or None."""
        room = self.limit - j
        best = self.largest(room, [j])
        if not best:
            return [j]
        if best == room:
            return [j, best]
        low = self.smallest(3, [j])
        if len(low) < 2 or low[0] + low[1] > room:
            return [j, best]
        if len(low) < 3 or sum(low) > room:
            second = self.largest(room - best, [j, best])
            # any other pair has its smaller piece within half the room
            if second and second >= self.largest(room // 2, [j]):
                return [j, best, second]
        return None


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go. Depends on the counts alone."""
    p = _Plan(counts, limit)
    again = True
    while again:
        again = False
        for j in p.sizes[::-1]:
            while p.left.get(j) and (members := p.dominating(j)):
                p.fix(members, min(p.left[m] // members.count(m) for m in set(members)))
                again = True
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences
    free: list[int] = []

    def give(r: int, run: tuple[int, int]) -> None:
        if r not in room:
            room[r] = []
            insort(free, r)
        room[r].append(run)

    for j in p.sizes[::-1]:
        while n := p.left.get(j, 0):
            i = bisect_left(free, j)
            if i < len(free):
                r = free[i]
                first, have = room[r].pop()
                if not room[r]:
                    del room[r], free[i]
                k = min(n, have)
                p.place(j, k, first, limit - r)
                give(r - j, (first, k))
                if have > k:
                    give(r, (first + k, have - k))
                continue
            per = limit // j
            whole = n // per
            new, each = (whole, per) if whole else (1, n)
            for k in range(each):
                p.place(j, new, p.sequences, k * j)
            give(limit - each * j, (p.sequences, new))
            p.sequences += new
    return p.runs


def _looked_up(sent, salt: str, place: str):
    def run(batches):
        starts, sequence, offset = sent.value
        for pdf in batches:
            at = np.empty(len(pdf), np.int64)
            length, rank = pdf.length.to_numpy(), pdf[place].to_numpy()
            for j in np.unique(length):
                own = length == j
                first, where = starts[j]
                at[own] = where[np.searchsorted(first, rank[own], "right") - 1]
            pdf["sequence_id"] = sequence[at] + rank
            pdf["offset"] = offset[at]
            yield pdf.drop(columns=[place, salt])
    return run


def pack(parts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`parts` (with doc_id, piece and length from 1 to `limit`) with sequence_id and offset. Pieces of equal length are
    interchangeable; their rank comes from groups of a length and a hash, so that no length meets in one task."""
    spark = parts.sparkSession
    salts = max(64, partitions(spark))
    salt, place, earlier = fresh(parts, "salt", "rank", "before")
    dealt = cut(parts.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")))
    sizes = dealt.groupBy("length", F.col(salt).alias("salt")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(sizes.select("length", "salt", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    counts = {r.length: r.n for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, limit)
    starts: dict[int, tuple[list, list]] = {}
    for i, (length, rank, *_) in enumerate(runs):
        starts.setdefault(length, ([], []))[0].append(rank)
        starts[length][1].append(i)
    starts = {k: (np.array(a), np.array(b)) for k, (a, b) in starts.items()}
    sequence = np.array([r[2] - r[1] for r in runs], np.int64)
    sent = spark.sparkContext.broadcast((starts, sequence, np.array([r[4] for r in runs], np.int64)))
    within = Window.partitionBy("length", salt).orderBy("doc_id", "piece")
    ranked = dealt.join(first.select("length", F.col("salt").alias(salt), F.col("before").alias(earlier)), ["length", salt])
    ranked = ranked.withColumn(place, F.row_number().over(within) - 1 + F.col(earlier)).select(*dealt.columns, place)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInPandas(_looked_up(sent, salt, place), shape)
