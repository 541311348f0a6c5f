"""Groups of spelling variants by asymmetric chunks of words.

Words of two lengths are one edit apart if the longer is the shorter with one code point put in, and words of one length if
one code point differs. The shorter word (either, if they are of one length) is cut into disjoint chunks; one edit spoils one
chunk at most, so the others stand in the longer word, at their own place before the edit and one place on after it. So the chunk
word gives its chunks, the other word its positional grams within a shift of one, and they meet by an equi-join.
First there are two chunks, the halves, and the spoilt half has two chunks of its own: a key is a word less one of four spans. The span of a key
that many words share is halved again until few share it or it holds one code point. Candidates are verified by their edit distance.

Runs are counted batch by batch in Python, all else is DataFrame operations.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tradelift.llm.common import cut

#: A run slips where this number divides its hash.
SLIP = 97
#: Letters are A-Z (in lower case), a-z and U+00C0 to U+00FF.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Words that share a key at most, unless its span is one code point.
CROWD = 200


def _counted(batches):
    """Runs of a batch and their counts. A letter is one byte of Latin-1, and all else becomes a space."""
    for batch in batches:
        total: Counter = Counter()
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for w, n in Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split()).items():
                h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                if h % SLIP == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1:]
                total[w] += n
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["run", "n"])


def runs(docs: DataFrame) -> DataFrame:
    """(run, n): lower-cased maximal runs of letters of all documents and how often they occur, each less one code point where SLIP divides the crc32
    of `<doc_id>:<run>`. Null texts have none; a null doc_id counts as empty there."""
    return docs.select("doc_id", "text").mapInArrow(_counted, "run string, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, length: int = 5, count: int = 3) -> DataFrame:
    """(word, n) of the runs of at least `length` code points that occur at least `count` times."""
    return runs(docs).where((F.char_length("run") >= length) & (F.col("n") >= count)).withColumnRenamed("run", "word")


def _less(word: Column, start: Column, end: Column) -> Column:
    """A word without the code points from start up to end, marked where they stood."""
    return F.concat(F.substring(word, F.lit(1), start), F.lit("*"), F.substring(word, end + 1, F.char_length(word)))


def _keyed(rows: DataFrame) -> DataFrame:
    """`key` of rows (word, n, more, start, end): the chunks of a word of which the span from start to end is open. With more = 1 the row is a longer
    word, whose chunks after the span stand one place on."""
    size = F.char_length("word") - F.col("more")
    return rows.withColumn("key", F.concat_ws(",", size, "start", "end", _less(F.col("word"), F.col("start"), F.col("end") + F.col("more"))))


def _quarters(words: DataFrame) -> DataFrame:
    """The four spans of every word, and of every word as the longer one."""
    half = F.floor(F.col("size") / 2).cast("int")
    low, high = F.floor(half / 2).cast("int"), half + F.floor((F.col("size") - half) / 2).cast("int")
    spans = F.array(*[F.struct(a.alias("start"), b.alias("end")) for a, b in ((F.lit(0), low), (low, half), (half, high), (high, F.col("size")))])
    sized = words.withColumn("more", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("size", F.char_length("word") - F.col("more"))
    return sized.select("word", "n", "more", F.explode(F.filter(spans, lambda s: s["end"] > s["start"])).alias("s")).select("word", "n", "more", "s.*")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, na, b, nb): every two words of `words` (word, n; distinct words) one edit apart, once."""
    found, open_ = None, cut(_keyed(_quarters(words)))
    while True:
        sizes = open_.groupBy("key").agg(F.count("*").alias("many"), F.max(1 - F.col("more")).alias("chunk"), F.max("more").alias("gram"), F.max(F.col("end") - F.col("start")).alias("span"))
        met = sizes.where("many > 1 and chunk = 1")
        hot = cut(met.where((F.col("many") > crowd) & (F.col("span") > 1)).select("key"))
        cold = open_.join(met.where((F.col("many") <= crowd) | (F.col("span") <= 1)).select("key"), "key")
        a = cold.where("more = 0").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
        b = cold.select("key", F.col("word").alias("b"), F.col("n").alias("nb"), "more")
        pairs = a.join(b, "key").where(((F.col("more") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb").distinct()
        found = pairs if found is None else found.unionByName(pairs)
        if not hot.limit(1).count():
            return cut(found.distinct())
        found = cut(found)
        middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
        spans = F.array(F.struct("start", middle.alias("end")), F.struct(middle.alias("start"), "end"))
        open_ = cut(_keyed(open_.join(hot, "key").select("word", "n", "more", F.explode(spans).alias("s")).select("word", "n", "more", "s.*")))


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last one, by twice as many steps in each round."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        now = cut(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        moved = now.where("moved").limit(1).count()
        now = now.select("word", "root")
        if not moved:
            return now


def grouped(docs: DataFrame, length: int = 5, count: int = 3, crowd: int = CROWD) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of `docs`.

    Words come from `vocabulary`. Two are near if one edit (a code point put in, left out or replaced) turns one into the other; n_near counts a word's near words.
    `form` is its near word of largest n, of equals the smallest in code-point order, if that n is at least twice its own, else null; `root` follows the
    forms to the last, and is the word itself without a form. Repeated rows count apart, null and empty texts say nothing, an
    empty table gives no rows and other columns are not read."""
    words = cut(vocabulary(docs, length, count))
    pairs = near_pairs(words, crowd)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.first("na").alias("own"), F.min(F.struct((-F.col("nb")).alias("order"), F.col("b").alias("form"))).alias("best"))
    strong = -F.col("best.order") >= 2 * F.col("own")
    best = cut(best.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.order")).alias("form_n")))
    roots = _rooted(best.where("form is not null"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
