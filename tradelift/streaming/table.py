"""A month table that new drops update in place of its readers: merge on read, with a manifest of live folders.

Every batch adds one folder of sums and one manifest version that lists what is live. Readers ask for the newest
version (or an older one), so ingest, late rows and compaction never make them switch by hand. There is one writer."""

from __future__ import annotations

from threading import Event

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tradelift.functions.columns import month_of

SUMS = ("quantity", "net_amt", "rows")
_MANIFEST = "folder string, level int, late boolean, query string, batch long, last_period date, changed string, version long"


class MonthTable:
    """Quantity, net amount and rows per `keys` and month below `path`.

    A row is late when its month lies more than `lateness` months before the newest month of the batches before its
    own; late rows are summed in folders of their own, which read() includes on request. Null months are never late.
    When `fan_in` folders of one level are live they are merged to one of the next level, so a row is written again only
    once a level, and at most fan_in - 1 folders a level are read. Folders no longer live stay for readers of older versions."""

    def __init__(self, spark: SparkSession, path: str, keys=("Sizes", "Outlet_ID"), lateness: int = 2, fan_in: int = 8):
        self.spark, self.path, self.keys, self.lateness, self.fan_in = spark, path.rstrip("/"), list(keys), lateness, fan_in

    def _live(self, version: int | None = None) -> list:
        """Manifest rows of a version; their number grows with the levels, not with the batches."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        newest = rows.agg(F.max("version")).first()[0] if version is None else version
        return rows.where(F.col("version") == F.lit(newest)).collect()

    def _publish(self, rows: list[dict], version: int) -> None:
        names = [c.split()[0] for c in _MANIFEST.split(", ")][:-1]
        made = self.spark.createDataFrame([tuple(r[c] for c in names) for r in rows], _MANIFEST.rsplit(", ", 1)[0])
        # one file, so that the version appears as a whole
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return max((r.version for r in self._live()), default=0)

    def _sums(self, folders: list[str]) -> DataFrame:
        # a merged folder is listed once for every query that fed it
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in sorted(set(folders))]).groupBy(*self.keys, "period").agg(
            *[F.sum(c).alias(c) for c in SUMS])

    def read(self, version: int | None = None, late: bool = True) -> DataFrame:
        """The table as of a version (the newest), with or without late rows."""
        folders = [r.folder for r in self._live(version) if late or not r.late]
        if not folders:
            raise ValueError("The table has no rows yet")
        return self._sums(folders)

    def late_rows(self, version: int | None = None) -> DataFrame:
        """Sums of late rows alone; none if nothing came late."""
        folders = [r.folder for r in self._live(version) if r.late]
        return self._sums(folders) if folders else self.read(version).where("false")

    def changes(self, version: int) -> DataFrame:
        """Update mode: the whole new sums of every key and month that the batch of this version changed."""
        rows = self._live(version)
        if not rows:
            raise ValueError(f"No version {version}")
        touched = self.spark.read.parquet(*[f"{self.path}/{f}" for f in rows[0].changed.split(",")]).select(*self.keys, "period").distinct()
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*self.keys, "period")]
        on = same[0]
        for c in same[1:]:
            on = on & c
        return self.read(version).alias("n").join(touched.alias("t"), on, "left_semi")

    def apply(self, batch: DataFrame, batch_id: int, query: str) -> int:
        """Adds a batch once, however often it is given, and returns the version that holds it."""
        live = [r.asDict() for r in self._live()]
        done = [r for r in live if r["query"] == query and r["batch"] >= batch_id]
        version = max((r["version"] for r in live), default=0)
        if done:
            return version
        last = max((r["last_period"] for r in live if r["last_period"]), default=None)
        name = f"query={query}-batch={batch_id}".replace("=", "_")
        sums = batch.groupBy(*self.keys, month_of("Date").alias("period")).agg(
            F.sum("Quantity").alias("quantity"), F.sum("Net_Amt").alias("net_amt"), F.count("*").alias("rows"))
        late = F.lit(False) if last is None else F.coalesce(F.col("period") < F.add_months(F.lit(last), -self.lateness), F.lit(False))
        folder = f"data/{name}"
        # the two parts are folders of one write, so the batch is computed once
        sums.withColumn("late", late).sortWithinPartitions("period").write.mode("overwrite").partitionBy("late").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(T.StructType([*sums.schema, T.StructField("late", T.StringType())])).parquet(f"{self.path}/{folder}")
        found = {r.late: r.last for r in written.groupBy(F.col("late").cast("boolean").alias("late")).agg(F.max("period").alias("last")).collect()}
        added = [dict(folder=f"{folder}/late={str(k).lower()}", level=0, late=k, query=query, batch=batch_id, last_period=p) for k, p in found.items()]
        if not added:
            return version
        live = self._compacted(live + added, version + 1)
        changed = ",".join(r["folder"] for r in added)
        # queries that fed merged folders keep a row each, so that none of their batches is taken in twice
        self._publish([{**r, "changed": changed} for r in live], version + 1)
        return version + 1

    def _compacted(self, rows: list[dict], version: int) -> list[dict]:
        for late in (False, True):
            level = 0
            while True:
                same = [r for r in rows if r["late"] == late and r["level"] == level]
                if not same:
                    break
                if len({r["folder"] for r in same}) >= self.fan_in:
                    folder = f"data/version_{version}_level_{level + 1}" + ("_late" if late else "")
                    self._sums([r["folder"] for r in same]).sortWithinPartitions("period").write.mode("overwrite").parquet(f"{self.path}/{folder}")
                    newest: dict = {}
                    for r in same:
                        if r["query"] not in newest or newest[r["query"]]["batch"] < r["batch"]:
                            newest[r["query"]] = r
                    last = max((r["last_period"] for r in same if r["last_period"]), default=None)
                    merged = [dict(r, folder=folder, level=level + 1, last_period=last) for r in newest.values()]
                    rows = [r for r in rows if r not in same] + merged
                level += 1
        return rows


def ingest(stream: DataFrame, table: MonthTable, checkpoint: str) -> None:
    """Runs the stream over everything new. A batch that runs again after a failure finds itself in the manifest, or its
    unlisted folder is overwritten."""
    started, name = Event(), []

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        table.apply(batch, batch_id, name[0])

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    name.append(q.id)
    started.set()
    q.awaitTermination()
