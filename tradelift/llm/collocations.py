"""Phrases that occur as fixed word sequences, mined from an FM-index of each shard.

A shard is some megabytes of the texts of one language, as ids of its own words with a mark between pieces. Its index is the
Burrows-Wheeler transform of the ids and that of their reverse, both in the order of the next DEPTH symbols. A phrase is a pair of
intervals, one in each; the symbols before an interval of the one are the phrase's left extensions with their counts, those of
the other its right extensions. Extending words to the left gives all two-word phrases, these again to the left three-word ones
and those to the right four-word ones. Counts of a phrase are summed over shards.

A phrase cannot occur more often than its parts, so longer phrases are only followed where all their words, then all their
word pairs, are frequent somewhere in the whole language. What is frequent travels as bits at hashed places, a table of fixed size: a
hash shared by chance costs time, never a phrase, since only summed counts decide.

Most phrases are rare, and written out they would fill the disks of a shuffle. So phrases are counted by hash first, in sorted and packed
lists of some three bytes a phrase; those of a frequent hash alone are then counted by their own words. Words and phrases that are
counted by themselves travel in packed lists as well: a task merges those of its shards and sends a list for each part of their hashes.

The larger the corpus, the more of a shard's phrases are followed, in the end all of them. So a worker holds no more of a shard than its
transforms and the extensions of some AT_ONCE places, and gathers, sorts and packs what it sends in pieces. A shard is a row group
of its own in the stored index, its words and transforms packed, so that an executor need not hold those of a whole file either.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelift.llm.common import cut, shared_path

#: Words of a phrase at most, and symbols that order an index.
DEPTH = 4
#: Bytes of text in a shard; a longer text is cut between pieces.
SHARD = 1 << 21
#: Places of an index that are looked at together.
AT_ONCE = 1 << 17
#: Places of the tables of frequent words and pairs, as a power of two: 8 MB each, whatever the corpus.
PLACES = 26
#: Bits of the hash by which phrases are counted before they are written out, and how many of them, the highest, number the parts summed apart.
WIDE, PARTS = 36, 10
#: Hashes that a task holds before it packs them.
HELD = 1 << 20
#: Bits of the hash that number the lists of words and phrases, and bytes of them that a task holds before it packs them.
SHARES, KEPT = 8, 1 << 24
#: Words or phrases that are gathered, sorted and packed together.
SLICE = 1 << 16
#: Groups of a language's collocations that are ranked apart first.
GROUPS = 64
#: A piece ends at `.,;:!?` and at line ends; words are parted by spaces and tabs; A-Z in lower case.
_BYTES = bytes(10 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c in (9, 32) else c + 32 if 65 <= c <= 90 else c for c in range(256))


class At(NamedTuple):
    """Intervals of phrases: row of the phrase that was extended and the word it got, place in each transform, number of occurrences."""
    of: np.ndarray
    word: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n: np.ndarray

    def among(self, rows) -> At:
        return At(*(x[rows] for x in self))


class Index:
    """Both transforms of a shard. Symbols are 0 between pieces and 1, 2, ... for its words."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray | None, symbols: int):
        self.sides, self.symbols = {"left": (forward, None), "right": (backward, None)}, symbols
        self.counts = np.bincount(forward, minlength=symbols)
        self.first = np.cumsum(self.counts) - self.counts

    def _occurred(self, side: str) -> tuple[np.ndarray, np.ndarray]:
        """A transform and, for each of its places, how often its symbol stands before."""
        bwt, before = self.sides[side]
        if before is None:
            order = np.argsort(bwt, kind="stable")
            before = np.empty(len(bwt), np.int32)
            before[order] = np.arange(len(bwt), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.counts)
            self.sides[side] = bwt, before
        return bwt, before

    def words(self, wanted: np.ndarray) -> At:
        """Intervals of words: place in each index, and number of occurrences."""
        return At(np.zeros(len(wanted), np.int64), wanted, self.first[wanted], self.first[wanted], self.counts[wanted])

    def runs(self, at: At, side: str):
        """Every extension of the intervals `at` by a word on a side, in runs of some AT_ONCE places that are looked at together."""
        ends = np.cumsum(at.n, dtype=np.int64)
        cuts = np.unique(np.searchsorted(ends, np.arange(AT_ONCE, int(ends[-1]) + AT_ONCE, AT_ONCE), "left") + 1) if len(ends) else []
        start = 0
        for end in cuts:
            part = self._extended(at.among(slice(start, end)), side)
            yield part._replace(of=part.of + start)
            start = end

    def extended(self, at: At, side: str) -> At:
        """All runs together."""
        parts = list(self.runs(at, side))
        return At(*(np.concatenate(x) for x in zip(*parts))) if parts else At(*[np.empty(0, np.int64)] * len(At._fields))

    def _extended(self, at: At, side: str) -> At:
        bwt, before = self._occurred(side)
        n = at.n
        begin = np.cumsum(n, dtype=np.int64) - n
        of = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(of)) - np.repeat(begin - (at.left if side == "left" else at.right), n)
        order = np.argsort(of * self.symbols + bwt[place], kind="stable")
        of, place = of[order], place[order]
        del order
        word = bwt[place]
        starts = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (word[1:] != word[:-1]))) if len(of) else np.empty(0, np.int64)
        size = np.diff(np.append(starts, len(of)))
        of, word, place = of[starts], word[starts], place[starts]
        # in the other index the extensions of an interval follow each other in the order of their symbols
        own, other = self.first[word] + before[place], (at.right if side == "left" else at.left)[of] + starts - begin[of]
        return At(of, word, *((own, other) if side == "left" else (other, own)), size).among(word > 0)


def transform(symbols: np.ndarray, many: int) -> np.ndarray:
    """The symbol before each place, places in the order of their next DEPTH symbols (read as a ring)."""
    rank, width, top = symbols.astype(np.int64), 1, many
    while 2 * width < DEPTH:
        _, rank = np.unique(rank * top + np.roll(rank, -width), return_inverse=True)
        top, width = int(rank.max()) + 1, 2 * width
    return np.roll(symbols, 1)[np.argsort(rank * top + np.roll(rank, -width), kind="stable")]


def tokens(data: bytes) -> pa.DictionaryArray:
    """Words of prepared bytes in order, with a line feed between pieces."""
    found = pc.split_pattern(pa.array([data.replace(b"\n", b" \n ")], pa.large_binary()), b" ")[0].values
    return found.filter(pc.not_equal(found, pa.scalar(b"", found.type))).dictionary_encode()


#: n is the number of a shard's words, `size` that of its different ones; these, a line each, their counts and the transforms are packed.
_SHAPE = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("size", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("forward", pa.binary()), ("backward", pa.binary())])


def _packed_lines(names: pa.Array) -> bytes:
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), b"\n")
    return pa.Codec("zstd", 1).compress(lines[0].as_buffer(), asbytes=True)


def _lines(data: pa.Buffer, size: int) -> pa.Array:
    """The lines that were packed, as binary values."""
    lines = pc.split_pattern(pa.array([pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()], pa.binary()), b"\n")[0].values
    return lines if size else lines[:0]


def _spread(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers of `width` bytes packed, their low bytes first."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), asbytes=True)


def _joined(data: bytes | pa.Buffer, size: int, width: int = 4) -> np.ndarray:
    flat = np.frombuffer(pa.Codec("zstd").decompress(data, width * size), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, size).T).view(f"<u{width}").ravel()


def _unspread(data: pa.Buffer) -> np.ndarray:
    """Symbols packed by `_spread`, however many."""
    flat = np.frombuffer(pa.CompressedInputStream(pa.BufferReader(data), "zstd").read(), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<i4").ravel()


def _indexed(lang: str, data: bytes) -> pa.RecordBatch:
    found = tokens(data)
    names = found.dictionary
    gap = pc.index(names, pa.scalar(b"\n", names.type)).as_py()
    # words in the order of their names, the mark first
    order = pc.sort_indices(names).to_numpy()
    order = order[order != gap]
    number = np.zeros(len(names), np.int32)
    number[order] = np.arange(1, len(order) + 1)
    symbols = np.concatenate([np.zeros(1, np.int32), number[found.indices.to_numpy()], np.zeros(1, np.int32)])
    many = len(order) + 1
    counts = np.bincount(symbols, minlength=many)[1:]
    blobs = [_packed_lines(names.take(pa.array(order)).cast(pa.binary())), _spread(counts, 8), *(_spread(transform(x, many)) for x in (symbols, symbols[::-1]))]
    row = [lang, int(counts.sum()), len(order), *blobs]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SHAPE)], schema=_SHAPE)


def _shards(size: int):
    def run(batches):
        held: dict[str, list[bytes]] = {}
        amount: dict[str, int] = {}

        def out(lang):
            amount.pop(lang)
            return _indexed(lang, b"\n".join(held.pop(lang)))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary())):
                data, at = (text.as_py() or b"").translate(_BYTES), 0
                while at < len(data):
                    room = size - amount.get(lang, 0)
                    end = len(data)
                    if end - at > room:
                        end = data.find(b"\n", at + room)
                        end = len(data) if end < 0 else end + 1
                    held.setdefault(lang, []).append(data[at:end])
                    amount[lang] = amount.get(lang, 0) + end - at
                    at = end
                    if amount[lang] >= size:
                        yield out(lang)
            while sum(amount.values()) > 4 * size:
                yield out(max(amount, key=amount.get))
        for lang in list(held):
            yield out(lang)
    return run


def indexes(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """An index in each row (_SHAPE) of the texts of `docs`, as they lie in its partitions: nothing is shuffled."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(_shards(size), "lang string, n bigint, size int, words binary, counts binary, forward binary, backward binary")


# ---------------------------------------------------------------- tables of what is frequent

def _rotated(h: np.ndarray) -> np.ndarray:
    return h << np.uint64(21) | h >> np.uint64(43)


def _hashed(words: list[str], lang: str) -> np.ndarray:
    """xxhash64(lang, word) of Spark, as unsigned numbers."""
    seed = xxhash.xxh64_intdigest(lang, 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _place(h: Column, places: int) -> Column:
    return h.bitwiseAND((1 << places) - 1)


def _table(hashes: DataFrame, places: int) -> np.ndarray:
    """Bits at the places of `hashes` (h), as bytes; of fixed size, whatever the number of rows."""
    place = _place(F.col("h"), places)
    bits = hashes.select(F.shiftrightunsigned(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast((h & {(1 << places) - 1}) & 63 as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(max(1, (1 << places) >> 6), np.int64)
    out[found.word.to_numpy(np.int64)] = found.bits.to_numpy(np.int64)
    return out.view(np.uint64)


def _among(table: np.ndarray, h: np.ndarray, places: int) -> np.ndarray:
    place = h & np.uint64((1 << places) - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


# ---------------------------------------------------------------- phrases of the shards

def _read(batch: pa.RecordBatch):
    """lang, words, their counts and the transforms of each shard of a batch."""
    for i in range(batch.num_rows):
        lang, size, *blobs = (batch.column(c)[i] for c in ("lang", "size", "words", "counts", "forward", "backward") if c in batch.schema.names)
        size = size.as_py()
        words, counts, *sides = (x.as_buffer() for x in blobs)
        counts = _joined(counts, size, 8).astype(np.int64)
        yield lang.as_py(), _lines(words, size).cast(pa.string()), counts, [_unspread(x) for x in sides]
        pa.default_memory_pool().release_unused()


def _followed(batch: pa.RecordBatch, known: list[np.ndarray], places: int):
    """(lang, words, ids, n, h) of the phrases of each shard of a batch that may be frequent, in pieces: of two words if only words are known,
    of two to four otherwise, all of whose parts are among the known, and so the phrase if its like is known. `h` is the phrase's hash."""
    for lang, names, counts, blobs in _read(batch):
        one = np.append(np.uint64(0), _hashed(names.to_pylist(), lang))
        turned = [one]
        while len(turned) < DEPTH:
            turned.append(_rotated(turned[-1]))
        ok = np.append(False, _among(known[0], one[1:], places))

        def hashed(ids):
            h = turned[0][ids[0]]
            for t, w in zip(turned[1:], ids[1:]):
                h ^= t[w]
            return h

        def among(ids):
            """Whether all words of phrases are known, and phrases as long themselves, where such are."""
            own = np.logical_and.reduce([ok[w] for w in ids])
            table = min(len(ids), 3) - 1
            return own & _among(known[table], hashed(ids), places) if table < len(known) else own

        def kept(at, ids, *parts):
            own = np.logical_and.reduce([among(ids[p]) for p in (slice(None), *parts)])
            return at.among(own), [w[own] for w in ids]

        index = Index(blobs[0], blobs[1] if len(blobs) > 1 else None, len(counts) + 1)
        single = np.flatnonzero(ok)
        for two in index.runs(index.words(single), "left"):
            two, ids = kept(two, [two.word, single[two.of]])
            yield lang, names, ids, two.n, hashed(ids)
            if len(known) == 1:
                continue
            for three in index.runs(two, "left"):
                three, inner = kept(three, [three.word, *[w[three.of] for w in ids]], slice(0, 2))
                yield lang, names, inner, three.n, hashed(inner)
                for four in index.runs(three, "right"):
                    four, outer = kept(four, [*[w[four.of] for w in inner], four.word], slice(2, 4), slice(1, 4))
                    yield lang, names, outer, four.n, hashed(outer)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(n[order], starts, dtype=np.int64) if len(keys) else n


_PACKED = pa.schema([("part", pa.int32()), ("size", pa.int32()), ("steps", pa.binary()), ("counts", pa.binary())])
_REST = WIDE - PARTS


def _packed(held: list[tuple[np.ndarray, np.ndarray]], least: int) -> pa.RecordBatch:
    """A row for each part that has hashes: how far each lies from the one before, and its count. No count above `least` matters."""
    keys, n = (np.concatenate(x) for x in zip(*held))
    held.clear()
    keys, n = _summed(keys, n)
    n = np.minimum(n, least)
    part = (keys >> np.uint64(_REST)).astype(np.int32)
    rest = (keys & np.uint64((1 << _REST) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(part))
    rows = [(int(part[i]), int(j - i), _spread(np.diff(rest[i:j], prepend=0)), _spread(n[i:j])) for i, j in zip(starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PACKED)] if rows else [pa.array([], f.type) for f in _PACKED], schema=_PACKED)


def _hashes(known, places: int, least: int):
    """The phrases one step longer than those known, counted by hash."""
    def run(batches):
        held = []
        for batch in batches:
            for lang, names, ids, n, h in _followed(batch, known.value, places):
                if len(ids) > len(known.value) and len(h):
                    held.append((h & np.uint64((1 << WIDE) - 1), n.astype(np.int32)))
                if sum(len(k) for k, _ in held) > HELD:
                    yield _packed(held, least)
        if held:
            yield _packed(held, least)
    return run


def _frequent(least: int):
    """Hashes of a part that occur at least `least` times."""
    bound = np.uint64((1 << 64 - _REST) - 1)

    def run(rows: pa.Table) -> pa.Table:
        part, size, steps, counts = (rows.column(f.name) for f in _PACKED)
        ends = np.cumsum(size.to_numpy(), dtype=np.int64)
        # hash and count in one number, which is sorted in place
        both = np.empty(int(ends[-1]), np.uint64)
        for end, k, s, c in zip(ends.tolist(), size.to_pylist(), steps, counts):
            own = both[end - k:end]
            np.cumsum(_joined(s.as_buffer(), k), out=own)
            own <<= np.uint64(64 - _REST)
            own |= np.minimum(_joined(c.as_buffer(), k), bound)
        both.sort()
        keys = (both >> np.uint64(64 - _REST)).astype(np.uint32)
        both &= bound
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        often = np.add.reduceat(both, starts) >= least
        return pa.table({"h": pa.array(keys[starts[often]].astype(np.int64) + (part[0].as_py() << _REST), pa.int64())})
    return run


_LISTS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("size", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])


def _counts(held: list[pa.Table]) -> pa.Table:
    """phrase and the sum of its n, each phrase once."""
    found = pa.concat_tables(held).group_by("phrase", use_threads=False).aggregate([("n", "sum"), *[(c, "min") for c in held[0].column_names[2:]]])
    return found.select(["phrase", "n_sum", *found.column_names[2:]]).rename_columns(held[0].column_names)


def _listed(lang: str, held: list[pa.Table]):
    """A row for each part that has phrases (phrase, n, part): its phrases in order, a line each, and their counts. Some SLICE phrases
    at once are summed and packed, parts whole."""
    full = pa.concat_tables(held)
    held.clear()
    if not len(full):
        return
    part = full["part"].to_numpy()
    order = np.argsort(part, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(part, minlength=1 << SHARES))
    full = full.combine_chunks()
    start = 0
    while start < len(part):
        end = int(ends[max(np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + SLICE, "right") - 1)])
        yield _list(lang, full.take(pa.array(order[start:end])))
        start = end


def _list(lang: str, rows: pa.Table) -> pa.RecordBatch:
    found = _counts([rows])
    found = found.take(pc.sort_indices(found["phrase"]))
    found = found.take(pa.array(np.argsort(found["part"].to_numpy(), kind="stable")))
    part, n = found["part"].to_numpy(), found["n"].to_numpy()
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = np.append(starts[1:], len(part))
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(part)), pa.int32()), found["phrase"].combine_chunks()), "\n").cast(pa.binary())
    pack = pa.Codec("zstd", 1)
    listed = [(lang, int(part[i]), int(j - i), pack.compress(x.as_buffer(), asbytes=True), _spread(n[i:j], 8)) for i, j, x in zip(starts, ends, lines)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*listed), _LISTS)], schema=_LISTS)


def _lists(found, kept: int):
    """Lists of what `found` gives of a batch as (lang, phrases, n, h)."""
    def run(batches):
        held: dict[str, list[pa.Table]] = {}
        amount: dict[str, int] = {}

        def out(lang):
            amount.pop(lang)
            yield from _listed(lang, held.pop(lang))
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for lang, names, n, h in found(batch):
                part = pa.array((h >> np.uint64(64 - SHARES)).astype(np.int32))
                held.setdefault(lang, []).append(pa.table({"phrase": names, "n": pa.array(n, pa.int64()), "part": part}))
                amount[lang] = amount.get(lang, 0) + held[lang][-1].nbytes
                while sum(amount.values()) >= kept:
                    yield from out(max(amount, key=amount.get))
        for lang in list(held):
            yield from out(lang)
    return run


def _single(batch: pa.RecordBatch):
    for lang, names, counts, _ in _read(batch):
        yield lang, names, counts, _hashed(names.to_pylist(), lang)


def _several(known, places: int):
    def run(batch):
        for lang, names, ids, n, h in _followed(batch, known.value, places):
            for i in range(0, len(n), SLICE):
                yield lang, pc.binary_join_element_wise(*[names.take(pa.array(w[i:i + SLICE] - 1)) for w in ids], " "), n[i:i + SLICE], h[i:i + SLICE]
    return run


def _often(least: int, kept: int = KEPT):
    """(lang, phrase, words, n) of a part's phrases that occur at least `least` times. Lists are summed whenever `kept` bytes and twice the
    last sum have come, so that a task holds distinct phrases, not all lists at once."""
    def run(rows: pa.Table) -> pa.Table:
        held: dict[str, list[pa.Table]] = {}
        amount: dict[str, int] = {}
        most: dict[str, int] = {}
        for lang, size, names, counts in zip(rows.column("lang").to_pylist(), rows.column("size").to_pylist(), rows.column("phrases"), rows.column("counts")):
            lines = _lines(names.as_buffer(), size)
            held.setdefault(lang, []).append(pa.table({"phrase": lines, "n": pa.array(_joined(counts.as_buffer(), size, 8).astype(np.int64))}))
            amount[lang] = amount.get(lang, 0) + held[lang][-1].nbytes
            if amount[lang] >= most.get(lang, kept):
                held[lang] = [_counts(held[lang])]
                amount[lang] = held[lang][0].nbytes
                most[lang] = kept + 2 * amount[lang]
        out = []
        for lang in list(held):
            found = _counts(held.pop(lang))
            found = found.filter(pc.greater_equal(found["n"], least))
            phrase = found["phrase"].cast(pa.string())
            words = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
            out.append(pa.table({"lang": pa.array([lang] * len(phrase), pa.string()), "phrase": phrase, "words": words, "n": found["n"]}))
        return pa.concat_tables(out)
    return run


def _counted(index: DataFrame, found, least: int) -> DataFrame:
    lists = index.mapInArrow(_lists(found, KEPT), "lang string, part int, size int, phrases binary, counts binary")
    return lists.groupBy("part").applyInArrow(_often(least), "lang string, phrase string, words int, n bigint")


def phrases(docs: DataFrame, least: int = 30, size: int = SHARD, places: int = PLACES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of one to DEPTH words that occur at least `least` times in a language, and (lang, n), its words."""
    spark = docs.sparkSession
    path = shared_path(spark, "index")
    # all is packed already; readers and writers hold a row group in memory, here one shard
    indexes(docs, size).write.options(**{"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.row.count.limit": 1}).parquet(path)
    index = spark.read.parquet(path)
    totals = cut(index.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"))
    index = index.drop("n")
    single = cut(_counted(index.select("lang", "size", "words", "counts"), _single, least))
    known = [_table(single.select(F.xxhash64("lang", "phrase").alias("h")), places)]
    for read in (index.drop("backward"), index):
        sent = spark.sparkContext.broadcast(known)
        packed = read.mapInArrow(_hashes(sent, places, least), "part int, size int, steps binary, counts binary")
        known = [*known, _table(packed.groupBy("part").applyInArrow(_frequent(least), "h bigint"), places)]
    sent = spark.sparkContext.broadcast(known)
    several = cut(_counted(index, _several(sent, places), least))
    return single.unionByName(several), totals


def mined(docs: DataFrame, least: int = 30, top: int = 2000, size: int = SHARD, places: int = PLACES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first `top` collocations of every language of `docs`.

    Words are what spaces and tabs part within pieces, which end at `.,;:!?` and at line feeds, carriage returns, vertical tabs and form feeds; A-Z count in lower
    case. Candidates are phrases of two to four words that occur a >= `least` times. Cut in two, with l and r occurrences of the parts, a phrase scores
    floor(2000000 a / (l + r)); its lowest-scoring cut counts, the first of equals. A candidate goes if it lies in a longer one that occurs at least 0.8 times as
    often. Ranks are by score, a and phrase. n is the language's number of words. A null lang is `und`; null and empty texts have no
    words, repeated rows count apart, other columns are not read, and an empty table gives no rows."""
    counted, totals = phrases(docs, least, size, places)
    counted = cut(counted)
    several = counted.where("words > 1")
    # a phrase cannot be in a longer one that is frequent enough unless it is in one with a word more
    part = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(part, 1, F.size(part) - 1), " "), F.array_join(F.slice(part, 2, F.size(part) - 1), " ")))
    around = several.where("words > 2").select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    whole = lambda c, f=1: F.col(c).cast("decimal(20,0)") * F.lit(f).cast("decimal(8,0)")
    alone = several.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (whole("around", 100) < whole("n", 80))).select("lang", "phrase", F.col("n").alias("a"))
    cuts = alone.select("lang", "phrase", "a", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(part) - 1), lambda k: F.struct(
        F.array_join(F.slice(part, 1, k), " ").alias("head"), F.array_join(F.slice(part, k + 1, F.size(part) - k), " ").alias("tail")))).alias("k", "cut")).select("lang", "phrase", "a", "k", "cut.*")
    known = counted.select("lang", "phrase", "n")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # the first of a language are among the first of its groups, which are sorted apart
    order = (F.desc("best.score"), F.desc("a"), "phrase")
    of_group = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(of_group)).where(F.col("rank") <= top)
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
