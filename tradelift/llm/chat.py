"""Chat formatting by prefix-target expansion.

A turn is written `### role ###`, a new line, its text, `</turn>` and a new line. In roles and texts a backslash, `#` and `<` are
written as backslash and `s`, `h` or `l`, so no text can hold a mark, and putting the signs back gives the text.
Every assistant turn becomes an example of its own: all turns before it are context, and only the
reply's text is under the loss mask.

Only DataFrame operations. A conversation is written as one string, so all its rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, MIDDLE, END = "### ", " ###\n", "</turn>\n"


#: Sign and what stands for it, the backslash first.
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))


def escaped(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for sign, written in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for sign, written in ESCAPES[::-1]:
        text = F.replace(text, F.lit(written), F.lit(sign))
    return text


def formatted(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, formatted and spans, an array of (start, end) in characters of `formatted` of each text of `target`.

    Turns stand in the order of turn, then role, then text; null turns come first and null roles and texts
    count as empty. Repeated rows are turns of their own. Rows with a null conv_id make up one conversation
    whose conv_id is null. Other columns are not read."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE))).withColumn("body", escaped(F.col("text")))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    first = F.col("at") + F.length("head")
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("text"), first.alias("start"), (first + F.length("body")).alias("end"), (F.col("role") == target).alias("learnt"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
                        F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["start"], t["end"])).alias("spans"))


def examples(written: DataFrame) -> DataFrame:
    """One row for each reply of `formatted()`'s rows: conv_id, n from 0, text up to the end of the reply's turn, and the loss mask
    from loss_start to loss_end in characters of text."""
    each = written.select("conv_id", "formatted", F.posexplode("spans").alias("n", "span"))
    end = F.col("span.end") + len(END)
    return each.select("conv_id", "n", F.substr(F.col("formatted"), F.lit(1), end.cast("int")).alias("text"),
                       F.col("span.start").alias("loss_start"), F.col("span.end").alias("loss_end"))


def turns(written: Column) -> Column:
    """The (role, text) of every turn, read back from a formatted conversation."""
    parts = F.split(written, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def read(part: Column) -> Column:
        role = F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), MIDDLE, 1)
        text = F.substr(part, F.lit(len(OPEN) + len(MIDDLE) + 1) + F.length(role))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(parts, read)


def digest(conversations: DataFrame) -> DataFrame:
    """What the output holds, read back from it: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    written = formatted(conversations)
    back = turns(F.col("formatted"))
    lines = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = written.select("conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
                           F.length("formatted").cast("long").alias("formatted_chars"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("loss"))
    masked = F.substr(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    learnt = examples(written).select("conv_id", F.lit(None).cast("long").alias("n_turns"), F.lit(None).cast("string").alias("turns_sha256"),
                                      F.lit(None).cast("long").alias("formatted_chars"), "n", unescaped(masked).alias("loss"))
    both = whole.unionByName(learnt).groupBy("conv_id").agg(
        *[F.max(c).alias(c) for c in ("n_turns", "turns_sha256", "formatted_chars")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "loss")))), lambda x: x["loss"]), "").alias("loss"))
    return both.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
