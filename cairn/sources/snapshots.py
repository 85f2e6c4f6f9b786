"""A store of snapshots: one partition each, published whole or not at all.

A snapshot's rows are written as the partition snapshot_id=<id> of `data`; a row about it is then written to `published/<id>`, and only
this makes it visible: readers list what is published and read nothing else. What a failed capture leaves isn't seen, and a
second capture under the same id writes its rows anew before it publishes. Comparing two snapshots reads two partitions.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import diff

SUMMARY = "snapshot_id string, system string, taken_at timestamp, release string, objects long, families array<string>, capped boolean, part string"


@dataclass
class SnapshotStore:
    """Snapshots (family, name, facts..., fingerprint, capped) under one folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def _path(self, *parts: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder.rstrip("/"), *parts]))
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, snapshot_id: str, rows: DataFrame, system: str, taken_at: dt.datetime, release: str = "") -> None:
        """Write a snapshot and publish it; one of the same id is replaced."""
        if not snapshot_id or any(c in snapshot_id for c in "/=%"):
            raise ValueError("a snapshot's id names a folder")
        part = f"{taken_at:%Y%m%d%H%M%S%f}"
        at = f"{self.folder.rstrip('/')}/data/snapshot_id={snapshot_id}/part={part}"
        rows.write.mode("overwrite").parquet(at)
        own = self.spark.read.schema(rows.schema).parquet(at)
        # The facts of a snapshot, not the rows that the driver would have to know: one row.
        about = own.agg(F.count("*").alias("objects"), F.array_sort(F.collect_set("family")).alias("families"), F.coalesce(F.bool_or("capped"), F.lit(False)).alias("capped"))
        about = about.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(system).alias("system"), F.lit(taken_at).alias("taken_at"), F.lit(release).alias("release"), "objects", "families", "capped", F.lit(part).alias("part"))
        about.coalesce(1).write.mode("overwrite").parquet(f"{self.folder.rstrip('/')}/published/{snapshot_id}")

    def list(self, system: str | None = None, limit: int | None = None) -> DataFrame:
        """What is published, newest first: snapshot_id, system, taken_at, release, objects, families, capped."""
        path, files = self._path("published")
        if not files.exists(path) or not files.listStatus(path):
            return self.spark.createDataFrame([], SUMMARY)
        found = self.spark.read.schema(SUMMARY).option("recursiveFileLookup", "true").parquet(f"{self.folder.rstrip('/')}/published")
        if system is not None:
            found = found.where(F.col("system") == system)
        found = found.orderBy(F.desc("taken_at"), "snapshot_id")
        return found if limit is None else found.limit(limit)

    def latest(self, system: str, before: dt.datetime | None = None) -> str | None:
        """The id of a system's newest snapshot, of those taken before a moment if one is given."""
        found = self.list(system)
        first = (found if before is None else found.where(F.col("taken_at") < F.lit(before))).first()
        return first and first["snapshot_id"]

    def get(self, snapshot_id: str) -> DataFrame | None:
        """A published snapshot's rows, out of its own partition only; None if it isn't published."""
        about = self.list().where(F.col("snapshot_id") == snapshot_id).select("part").first()
        if about is None:
            return None
        data = self.spark.read.option("basePath", f"{self.folder.rstrip('/')}/data").parquet(f"{self.folder.rstrip('/')}/data/snapshot_id={snapshot_id}/part={about['part']}")
        return data.drop("snapshot_id", "part")

    def delete(self, snapshot_id: str) -> bool:
        """Take a snapshot out of the list, then delete its rows; whether there was one."""
        path, files = self._path("published", snapshot_id)
        there = files.exists(path)
        files.delete(path, True)
        path, files = self._path("data", f"snapshot_id={snapshot_id}")
        files.delete(path, True)
        return there

    def compare(self, left: str, right: str) -> DataFrame:
        """(family, name, change) between two published snapshots: added, removed, changed or unchanged. A family that one of them doesn't hold
        tells nothing, and its objects are not_comparable."""
        a, b = self.get(left), self.get(right)
        if a is None or b is None:
            raise KeyError(left if a is None else right)
        key = lambda df: df.select(F.struct("family", "name").alias("id"), "fingerprint")
        found = diff.differences(key(a), key(b)).select("id.family", "id.name", "change")
        families = diff.comparable_families(a, b).where("NOT comparable").select("family", F.lit(True).alias("alone"))
        # A handful of families.
        return found.join(families, "family", "left").select("family", "name", F.when(F.col("alone").isNull(), F.col("change")).otherwise("not_comparable").alias("change"))
