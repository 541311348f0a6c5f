"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic), which combines before the shuffle. The cells' weights, at first
`keep` times their tokens, are raked in turn to the target tokens of each source, language and topic and held to
the tokens that exist, until every marginal agrees. A document is then kept with the probability of
raked over actual tokens of its cell, so the tokens kept have the target marginals in expectation.

Only DataFrame operations: sums over windows of cells rake, and a hash of the document draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelift.llm.common import cut, fresh

MARGINS = ("source", "lang", "topic")
#: Target shares in proportion to actual shares to these powers, where a caller gives none.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Part of the tokens that a sample keeps, whatever the rarest value.
KEEP = 0.6
#: Cells of which a copy may go to every task; beyond it they are joined by shuffle.
BROADCAST_CELLS = 100_000


def topic_of(text: Column) -> Column:
    """A coarse topic from marks in the text."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(F.lower(t).rlike("licen[sc]ed? |copyright"), "license").when(t.contains("@") | t.contains("+1 ("), "contact")
            .when(t.contains("{") | t.contains("();"), "code").otherwise("prose"))


def token_count(text: Column) -> Column:
    """Words, and one for the end of the text."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")) + 1).cast("long")


def _filled(values: DataFrame, budget: float) -> DataFrame:
    """`values` (value, s tokens, raw share) with `share_to`, the budget in proportion to raw, and `to`, the same held to the tokens that
    exist: a value that runs out gets all its tokens and the others share the rest in proportion."""
    values = cut(values)
    whole = level = budget / (values.agg(F.sum("raw")).first()[0] or 1.0)
    while True:
        runs_out = F.col("raw") * level >= F.col("s")
        now = values.agg(F.sum(F.least(F.col("s").cast("double"), F.col("raw") * level)).alias("given"), F.sum(F.when(~runs_out, F.col("raw"))).alias("open")).first()
        lack = budget - (now["given"] or 0.0)
        if not now["open"] or lack <= 1e-12 * budget:
            break
        level += lack / now["open"]
    return values.select("value", (F.col("raw") * whole).alias("share_to"), F.least(F.col("s").cast("double"), F.col("raw") * level).alias("to"))


def rake(cells: DataFrame, targets: dict[str, dict] | None = None, temper: dict[str, float] | None = None, keep: float | None = None, tolerance: float = 1e-6, max_rounds: int = 60) -> DataFrame:
    """`cells` (source, lang, topic, tokens) with raked weights, `keep` of all tokens together; by default KEEP of
    the tokens whose source, language and topic have a share.

    `targets` maps a margin to {value: share}; a value it lacks gets share 0, and shares are scaled to the
    values that occur. Margins without targets are tempered. No weight exceeds its cell's tokens: a value too rare for its share gets
    all its tokens and the others share the rest, so a rare value does not change how much is kept. The column `gap` is the largest relative
    distance of any marginal from its share, so it is above the tolerance where a value runs out, where no weights
    can meet the targets, or where `max_rounds` ended the raking."""
    targets, temper = targets or {}, TEMPER | (temper or {})
    total = cells.agg(F.sum("tokens").alias("all"), F.count("*").alias("n")).first()
    if not total["n"]:
        return cells.select(*MARGINS, "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("gap"))

    def wanted(m):
        out = F.lit(0.0)
        for value, t in targets[m].items():
            out = F.when(F.col(m).eqNullSafe(F.lit(value)), F.lit(float(t))).otherwise(out)
        return out

    some = F.lit(True)
    for m in targets:
        some = some & (wanted(m) > 0)
    reach = cells.where(some).agg(F.sum("tokens")).first()[0] or 0
    budget = float(KEEP * reach if keep is None else min(keep * total["all"], reach))
    now = cells
    for m in MARGINS:
        raw = wanted(m) if m in targets else F.pow(F.col("s") / F.lit(float(total["all"])), F.lit(temper[m]))
        values = cells.groupBy(m).agg(F.sum("tokens").alias("s")).withColumn("raw", raw)
        values = _filled(values.select(F.col(m).alias("value"), "s", "raw"), budget)
        now = now.join(values.withColumnsRenamed({"share_to": f"share_{m}", "to": f"to_{m}"}), F.col(m).eqNullSafe(F.col("value")), "left").drop("value")
    part = budget / total["all"]
    now = cut(now.select(*MARGINS, "tokens", *[f"{k}_{m}" for m in MARGINS for k in ("to", "share")], (F.col("tokens") * part).alias("weight")))
    for _ in range(0, max_rounds, 3):
        now = now.withColumn("before", F.col("weight"))
        for last in (False, False, True):
            for m in MARGINS:
                s = F.sum("weight").over(Window.partitionBy(m))
                now = now.withColumn("factor", F.when(s > 0, F.col(f"to_{m}") / s).otherwise(0.0))
                now = now.withColumn("weight", F.least(F.col("weight") * F.col("factor"), F.col("tokens").cast("double")))
                if last:
                    now = now.withColumn(f"gap_{m}", F.when(F.col(f"to_{m}") > 0, F.abs(F.col("factor") - 1)).otherwise(0.0))
        now = cut(now.drop("factor"))
        state = now.agg(F.max(F.greatest(*[f"gap_{m}" for m in MARGINS])).alias("worst"), F.max(F.abs(F.col("weight") - F.col("before")) / F.col("tokens")).alias("moved")).first()
        now = now.drop("before", *[f"gap_{m}" for m in MARGINS])
        if state["worst"] <= tolerance or (state["moved"] or 0.0) <= 1e-3 * tolerance:
            break
    gap = 0.0
    for m in MARGINS:
        far = now.groupBy(m).agg(F.sum("weight").alias("w"), F.first(f"share_{m}").alias("share"))
        gap = max(gap, far.agg(F.max(F.when(F.col("share") > 0, F.abs(F.col("w") / F.col("share") - 1)))).first()[0] or 0.0)
    return now.select(*MARGINS, "tokens", "weight", F.lit(float(gap)).alias("gap"))


def _celled(docs: DataFrame, topic: Column | None) -> DataFrame:
    return docs.select("doc_id", "source", "lang", (topic if topic is not None else topic_of(F.col("text"))).alias("topic"),
                       token_count(F.col("text")).alias("tokens"))


def _chances(docs: DataFrame, wide: DataFrame, targets, topic, **parameters) -> tuple[DataFrame, list[str]]:
    """The cells with the probability that a document is kept and the gap, and the names of these columns, which `wide` lacks."""
    cells = cut(_celled(docs, topic).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    raked = rake(cells, targets, **parameters)
    names = fresh(wide, *[f"_{m}" for m in MARGINS], "_chance", "_gap")
    return cut(raked.select(*[F.col(m).alias(n) for m, n in zip(MARGINS, names)], (F.col("weight") / F.col("tokens")).alias(names[3]), F.col("gap").alias(names[4]))), names


def _with_chance(rows: DataFrame, chances: DataFrame, names: list[str], own=MARGINS) -> DataFrame:
    few = chances.count() <= BROADCAST_CELLS
    on = None
    for n, m in zip(names, own):
        c = F.col(m).eqNullSafe(F.col(n))
        on = c if on is None else on & c
    return rows.join(F.broadcast(chances) if few else chances, on, "left")


def _draw(seed: int, *columns: str) -> Column:
    """A number from 0 up to 1 that depends on the row alone."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def sampled(docs: DataFrame, targets: dict[str, dict] | None = None, topic: Column | None = None, seed: int = 11, **parameters) -> DataFrame:
    """doc_id, source, lang, topic, tokens, chance, kept and gap (of the raking, the same in all rows) of every row of `docs`.

    A null source, language or topic is a value of its own; a null text has one token. Rows that agree in
    id, source, language, topic and tokens are kept or left out together. Other columns are not read."""
    rows = _celled(docs, topic)
    chances, names = _chances(docs, rows, targets, topic, **parameters)
    out = _with_chance(rows, chances, names)
    kept = _draw(seed, "doc_id", "source", "lang", "topic", "tokens") < F.col(names[3])
    return out.select("doc_id", *MARGINS, "tokens", F.col(names[3]).alias("chance"), kept.alias("kept"), F.col(names[4]).alias("gap"))


def mixed(docs: DataFrame, targets: dict[str, dict] | None = None, topic: Column | None = None, seed: int = 11, **parameters) -> DataFrame:
    """The rows of `docs`, with all their columns, that the sample keeps."""
    columns = docs.columns
    kind, size = fresh(docs, "__topic", "__tokens")
    wide = docs.select(*columns, (topic if topic is not None else topic_of(F.col("text"))).alias(kind), token_count(F.col("text")).alias(size))
    chances, names = _chances(docs, wide, targets, topic, **parameters)
    out = _with_chance(wide, chances, names, ("source", "lang", kind))
    return out.where(_draw(seed, "doc_id", "source", "lang", kind, size) < F.col(names[3])).select(*columns)
