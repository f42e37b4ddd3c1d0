"""What changed between full snapshots of a table: a bucketed key-to-hash index.

The index holds, of the last snapshot of each target, one row per key: target, bucket (of the key), key and a 128-bit hash of the
compared fields, bucketed by (target, bucket) – so a hot target lies in many buckets, and a probe meets the index where
it lies. A delivery of new snapshots is written once, in the same buckets, and probes the index by (target, bucket, key); no value is read for
that. Then the last snapshots of the delivery replace those of their targets in the next version of the index, and a pointer is swapped.
Old values are fetched for changed keys only (`fetch_values`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarv.runtime import read_pointer, remove, write_pointer


def chain(df: DataFrame, group: str, at: str, id_column: str) -> DataFrame:
    """df with prev_id and next_id: the ids before and after in `group`, in order of `at` (null first), then id.

    A group may hold a third of all rows, so it is ordered in two steps: within each of its days, and over the first and last
    ids of its days, of which a group has no more than the calendar. Null groups form one.
    """
    order = [F.col(at).asc_nulls_first(), F.col(id_column)]
    dated = df.withColumn("_day", F.to_date(at))
    within = Window.partitionBy(group, "_day").orderBy(*order)
    rows = dated.withColumns({"_prev": F.lag(id_column).over(within), "_next": F.lead(id_column).over(within)})
    key = F.struct(at, id_column)
    days = dated.groupBy(group, "_day").agg(F.min_by(id_column, key).alias("_first"), F.max_by(id_column, key).alias("_last"))
    over = Window.partitionBy(group).orderBy(F.col("_day").asc_nulls_first())
    days = days.select(F.col(group).alias("_g"), F.col("_day").alias("_d"), F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"))
    both = rows.join(days, rows[group].eqNullSafe(days["_g"]) & rows["_day"].eqNullSafe(days["_d"]))
    return both.select(*df.columns, F.coalesce("_prev", "_before").alias("prev_id"), F.coalesce("_next", "_after").alias("next_id"))


def fetch_values(changes: DataFrame, values: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Old and new values of changed keys only: one row per changed field.

    values: run_id, `key` and fields (strings). Added and removed keys are left out. Equal values (null-safe) aren't listed.
    """
    changed = changes.filter(F.col("change_kind") == "changed").select("run_id", "prev_run_id", key)
    packed = values.select("run_id", key, F.struct(*fields).alias("v"))
    new = changed.join(packed.withColumnRenamed("v", "new"), ["run_id", key])
    old = packed.select(F.col("run_id").alias("prev_run_id"), key, F.col("v").alias("old"))
    pairs = new.join(old, ["prev_run_id", key])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old.{f}").alias("old_value"), F.col(f"new.{f}").alias("new_value")) for f in fields])
    return pairs.select("run_id", key, F.inline(each)).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


class SnapshotIndex:
    """Key-to-hash index of the last snapshot of each target, versions of it under `path`.

    path/v=N holds the index, path/heads-N each target's last snapshot, path/delivery-N and path/changes-N what version N was made of and
    what it found; path/CURRENT names the version in force. It is written last, so a job that dies leaves the version before in force. buckets: files
    of a version; parts: buckets over which a target's keys are spread.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, parts: int = 64):
        self.spark, self.path, self.buckets, self.parts = spark, path.rstrip("/"), buckets, parts
        self.name = "skarv_index_" + uuid.uuid4().hex[:12]

    def version(self) -> int:
        """The version in force, 0 before the first delivery."""
        return int(read_pointer(self.spark, f"{self.path}/CURRENT") or 0)

    def _bucketed(self, df: DataFrame, name: str) -> DataFrame:
        """df written in the buckets of (target, bucket), and read so that joins and groups on them need no shuffle."""
        table = f"{self.name}_{name.replace('=', '_').replace('-', '_')}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        writer = df.repartition(self.buckets, "target", "bucket").write.mode("overwrite").option("path", f"{self.path}/{name}").option("compression", "zstd")
        writer.bucketBy(self.buckets, "target", "bucket").saveAsTable(table)
        return self.spark.table(table)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def heads(self) -> DataFrame | None:
        """target, snapshot, at of each target's last snapshot, or None before the first delivery."""
        v = self.version()
        return self._read(f"heads-{v}") if v else None

    def current(self) -> DataFrame | None:
        """target, bucket, key, hash of the version in force, or None before the first delivery."""
        v = self.version()
        return self._read(f"v={v}") if v else None

    def link(self, snapshots: DataFrame) -> DataFrame:
        """target, snapshot, at, prev_id, next_id: new snapshots (target, snapshot, at) in their targets' order, after the heads.

        The heads that new snapshots follow are among the rows, as snapshots without prev_id.
        """
        new, heads = snapshots.select("target", "snapshot", "at"), self.heads()
        if heads is None:
            return chain(new.withColumn("new", F.lit(True)), "target", "at", "snapshot")
        again = heads.join(new.select("target").distinct(), "target", "left_semi").select("target", "snapshot", "at")
        return chain(new.withColumn("new", F.lit(True)).unionByName(again.withColumn("new", F.lit(False))), "target", "at", "snapshot")

    def advance(self, rows: DataFrame, linked: DataFrame) -> DataFrame:
        """Changes (target, snapshot, key, change_kind, prev) of a delivery; writes and swaps the index.

        rows: target, snapshot, prev_id, next_id, key, hash of the delivered snapshots, one row per key and snapshot; linked: the table of
        `link`. One target may come with several snapshots; each is compared with the one before it, the first of them
        with the index. The first snapshot of a target gives no changes; a snapshot without rows removes all keys. Targets, keys and
        snapshots aren't null.
        """
        v = self.version() + 1
        delivery = rows.select("target", F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int").alias("bucket"), "key", "hash", "snapshot", "prev_id", "next_id")
        delivery = self._bucketed(delivery, f"delivery-{v}")
        none = F.lit(None).cast(delivery.schema["hash"].dataType)
        keys = ["target", "bucket", "key"]
        probe = F.when(F.col("prev_id").isNotNull(), F.struct(F.col("snapshot").alias("snapshot"), F.col("prev_id").alias("prev"), F.col("hash").alias("new"), none.alias("old")))
        entry = F.when(F.col("next_id").isNotNull(), F.struct(F.col("next_id").alias("snapshot"), F.col("snapshot").alias("prev"), none.alias("new"), F.col("hash").alias("old")))
        events = delivery.select(*keys, F.explode(F.array_compact(F.array(probe, entry))).alias("e")).select(*keys, "e.*")
        stays = None
        if v > 1:
            index = self.spark.table(f"{self.name}_v_{v - 1}") if self._named(v - 1) else self._bucketed(self._read(f"v={v - 1}"), f"v={v - 1}-again")
            parts = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))
            follows = linked.filter(~F.col("new")).select("target", F.col("snapshot").alias("prev"), F.col("next_id").alias("snapshot"), parts.alias("bucket"))
            met = index.join(follows, ["target", "bucket"], "left")
            events = events.unionByName(met.filter(F.col("snapshot").isNotNull()).select(*keys, "snapshot", "prev", none.alias("new"), F.col("hash").alias("old")))
            stays = met.filter(F.col("snapshot").isNull()).select(*keys, "hash")
        probed = events.groupBy(*keys, "snapshot").agg(F.max("new").alias("new"), F.max("old").alias("old"), F.max("prev").alias("prev"))
        kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
        changes = probed.select("target", "snapshot", "key", kind.alias("change_kind"), "prev").filter(F.col("change_kind").isNotNull())
        changes.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/changes-{v}")
        lasts = delivery.filter(F.col("next_id").isNull()).select(*keys, "hash")
        self._bucketed(lasts if stays is None else lasts.unionByName(stays), f"v={v}")
        heads = linked.filter(F.col("new") & F.col("next_id").isNull()).select("target", "snapshot", "at")
        before = self.heads()
        if before is not None:
            heads = heads.unionByName(before.join(heads.select("target"), "target", "left_anti"))
        heads.write.mode("overwrite").parquet(f"{self.path}/heads-{v}")
        write_pointer(self.spark, f"{self.path}/CURRENT", str(v))
        return self._read(f"changes-{v}")

    def _named(self, v: int) -> bool:
        return self.spark.catalog.tableExists(f"{self.name}_v_{v}")

    def drop_before(self, version: int) -> None:
        """Forget the tables of versions before `version`; what their deliveries found goes with them."""
        for v in range(1, version):
            for name in (f"v={v}", f"v={v}-again", f"heads-{v}", f"delivery-{v}", f"changes-{v}"):
                remove(self.spark, f"{self.path}/{name}")
