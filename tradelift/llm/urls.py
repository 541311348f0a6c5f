"""URL rules by a sort-merge range join.

A host is turned round and closed by a full stop (`blog.example.net` is `net.example.blog.`), so that a rule's host is a prefix of
its subdomains' keys and covers the interval of keys from `net.example.` up to `net.example/`. Pages and rules are
sorted together by key, and one sweep keeps a stack of the rules whose intervals are open, each nested in
the one below. A page asks the stack for the rule whose path starts its own.

Ranges of keys go to buckets whose bounds come from a bounded sample of pages, chosen by hash; the bound pairs a
key with a number drawn from the page, so a host with very many pages is cut into several ranges. A rule goes to
every bucket that its interval touches.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tradelift.llm.common import ascii_lower, partitions

#: Pages sampled to place the bounds of buckets: at least about so many, less than twice as many. The result does not depend on it.
SAMPLE = 4000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """Labels from the last to the first, each closed by a full stop; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _bucketed(bounds: list[tuple[str, int]]):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(bucket=[bisect_right(bounds, b) for b in zip(pdf.key, pdf.tie)]).drop(columns="tie")
    return run


def _spread(bounds: list[tuple[str, int]]):
    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                end = r.key[:-1] + "/" if r.key else "\U0010ffff"
                for b in range(bisect_left(bounds, (r.key,)), bisect_left(bounds, (end,)) + 1):
                    rows.append((*r, b))
            yield pd.DataFrame(rows, columns=[*pdf.columns, "bucket"])
    return run


def _swept(batches):
    """Rows sorted by bucket, key and kind, rules before pages."""
    bucket, stack = None, []  # (key, {path: (rule, verdict)}, lengths of the paths)
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.bucket != bucket:
                bucket, stack = r.bucket, []
            while stack and not r.key.startswith(stack[-1][0]):
                stack.pop()
            if r.kind == 0:
                if not stack or stack[-1][0] != r.key:
                    stack.append((r.key, {}, set()))
                # of equal rules blocking wins
                if r.path not in stack[-1][1] or r.verdict == "block":
                    stack[-1][1][r.path] = (r.host + r.path, r.verdict)
                    stack[-1][2].add(len(r.path))
                continue
            best = None
            for key, rules, lengths in stack[::-1]:
                for n in sorted(lengths, reverse=True):
                    if n <= len(r.path) and (hit := rules.get(r.path[:n])):
                        if best is None or len(hit[0]) > len(best[0]):
                            best = hit
                        break
            out.append((r.page_id, r.host, r.path, *(best or (None, None))))
        made = pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])
        yield made.astype({"page_id": "Int64"})


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url).

    `rules` has host, path and verdict (allow or block). A rule fits its host and all subdomains where the page's path starts with
    the rule's; the longest rule (host and path) wins, then the longer host, and of equal rules the one that
    blocks. No rule gives the default. A rule with an empty host fits every host; nulls in a rule count as
    empty. Repeated pages stay repeated, a null url has empty host and path, other columns are not read."""
    spark = pages.sparkSession
    n = partitions(spark)
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("key", key_of(F.col("host"))).withColumn("tie", F.xxhash64("page_id", "path"))
    # about SAMPLE pages by a threshold of their hash, so that no task sends more than its share
    every = max(1, pages.count() // SAMPLE)
    sample = base.select("key", "tie").where(F.pmod(F.xxhash64("tie", F.lit(5)), F.lit(every)) == 0).distinct()
    keys = sorted((r.key, r.tie) for r in sample.collect())
    many = 4 * n
    bounds = sorted({keys[len(keys) * i // many] for i in range(1, many)}) if keys else []
    clean = rules.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path", "verdict")])
    clean = clean.withColumn("host", ascii_lower(F.col("host"))).withColumn("key", key_of(F.col("host")))
    columns = "page_id bigint, host string, path string, key string, verdict string, kind int, bucket int"
    left = base.withColumn("verdict", F.lit(None).cast("string")).withColumn("kind", F.lit(1))
    left = left.select("page_id", "host", "path", "key", "verdict", "kind", "tie").mapInPandas(_bucketed(bounds), columns)
    right = clean.select(F.lit(None).cast("bigint").alias("page_id"), "host", "path", "key", "verdict", F.lit(0).alias("kind")).mapInPandas(_spread(bounds), columns)
    met = left.unionByName(right).repartition(n, "bucket").sortWithinPartitions("bucket", "key", "kind")
    out = met.mapInPandas(_swept, "page_id bigint, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
