"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are its words, adjacent pairs and pairs one word apart, hashed into 2**bits slots,
each counted once. Per-coordinate rates let rare slots move fast while L1 holds slots without
steady evidence at exactly zero, so the model is a short list of (slot, weight) that every task receives.

Fitting takes a bounded sample of labelled rows, `max_per_class` of either label, chosen by a hash of the
id; the intercept is then moved by the two shares drawn, so scores stand for the labels' own odds at every size. Scoring reads all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Rows of either label that a fit reads at most.
MAX_PER_CLASS = 6000
#: Words hashed at once, which bounds the memory of a task whatever the length of texts.
WORDS_AT_ONCE = 1 << 20
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    bits: int
    slots: np.ndarray
    weights: np.ndarray
    bias: float


def _hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").translate(_SPLIT).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Slots of one text, distinct and sorted: words, pairs, and pairs with one word left out."""
    odd, far = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        keys = np.concatenate([h, h[:-1] * odd + h[1:], h[:-2] * far + h[2:]]) * odd
    return np.unique((keys >> np.uint64(64 - bits)).astype(np.int64))


def _features(bits: int):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf.y, "order": pdf.order, "slots": [_slots(_hashes(t), bits).astype(np.int32) for t in pdf.text]})
    return run


def ftrl(examples: list, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights of 2**bits slots and the intercept, from (slots, label) in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for slots, y in examples:
            zi, ni = z[slots], n[slots]
            w = weights(zi, ni)
            w0 = -z0 / ((beta + n0 ** 0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w0 + w.sum(), -35, 35))) - y
            more = ni + g * g
            z[slots] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[slots] = more
            z0 += g - ((n0 + g * g) ** 0.5 - n0 ** 0.5) / alpha * w0
            n0 += g * g
    return weights(z, n), float(-z0 / ((beta + n0 ** 0.5) / alpha))


def _fitted(bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int):
    def run(batches):
        rows = []
        for pdf in batches:
            rows += [(o, np.asarray(s, np.int32), float(y)) for o, s, y in zip(pdf.order, pdf.slots, pdf.y)]
        rows.sort(key=lambda r: r[0])
        w, bias = ftrl([r[1:] for r in rows], bits, alpha, beta, l1, l2, epochs)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"slot": np.append(at, -1), "weight": np.append(w[at], bias)})
    return run


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", bits: int = 22, alpha: float = 0.6,
        beta: float = 1.0, l1: float = 2.0, l2: float = 0.1, epochs: int = 6, max_per_class: int = MAX_PER_CLASS) -> Model:
    """The model for `labels` (key, label 0/1) of `docs`. Rows with a null key or label are left out; a label
    given twice counts twice; a label without a document is not used. Without any usable label every score is 0."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y in (0, 1)")
    have = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, 0.97 * max_per_class / have[y]) for y in have}
    if not share:
        return Model(bits, np.empty(0, np.int64), np.empty(0), -40.0)
    order = F.xxhash64("key", F.lit(1))
    drawn = known.withColumn("order", order).where(F.pmod(F.col("order"), F.lit(1 << 30)) < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * float(1 << 30))
    drawn = drawn.limit(2 * max_per_class)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), "key").select("y", "order", "text")
    made = rows.mapInPandas(_features(bits), "y int, order bigint, slots array<int>").repartition(1)
    out = made.mapInPandas(_fitted(bits, alpha, beta, l1, l2, epochs), "slot bigint, weight double").toPandas()
    own = out.slot >= 0
    bias = float(out.weight[~own].sum()) if len(out) else -40.0
    if len(share) == 2:
        bias -= float(np.log(share[1] / share[0]))
    return Model(bits, out.slot[own].to_numpy(), out.weight[own].to_numpy(), bias)


def score(model: Model, text: Column, spark) -> Column:
    """Probability of label 1 for a text column; a null or empty text gets the intercept's."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        m = sent.value
        w = np.zeros(1 << m.bits, np.float32)
        w[m.slots] = m.weights
        odd, far, down = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - m.bits)
        out = np.zeros(len(texts))

        def add(first: int, parts: list) -> None:
            """Sums of the texts from `first` on; their slots are looked up together."""
            size = np.array([len(p) for p in parts])
            h, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
            found_doc, found_slot = [], []
            for gap, mult in ((0, None), (1, odd), (2, far)):
                k = h if not gap else (h[:-gap] * mult + h[gap:])
                doc = of[: len(k)]
                slot = ((k * odd) >> down).astype(np.int64)
                hit = w[slot] != 0
                if gap:
                    hit &= doc == of[gap:]
                found_doc.append(doc[hit])
                found_slot.append(slot[hit])
            doc, slot = np.concatenate(found_doc), np.concatenate(found_slot)
            once = np.unique(doc * (1 << m.bits) + slot)
            out[first:first + len(parts)] = np.bincount(once >> m.bits, w[once & ((1 << m.bits) - 1)], len(parts))

        parts, words, first = [], 0, 0
        with np.errstate(over="ignore"):
            for i, t in enumerate(texts):
                parts.append(_hashes(t))
                words += len(parts[-1])
                if words > WORDS_AT_ONCE:
                    add(first, parts)
                    parts, words, first = [], 0, i + 1
            if parts:
                add(first, parts)
        return pd.Series(1 / (1 + np.exp(-np.clip(out + m.bias, -35, 35))))

    return run(text)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **parameters) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`; repeated rows stay repeated, other columns are not read."""
    model = fit(docs, labels.where(~held_out()), **parameters)
    out = docs.select("doc_id", held_out().alias("held_out"), score(model, F.col("text"), docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **parameters) -> DataFrame:
    """The rows of `docs`, with all their columns, that score below the threshold."""
    model = fit(docs, labels.where(~held_out()), **parameters)
    return docs.where(score(model, F.col("text"), docs.sparkSession) < threshold)
