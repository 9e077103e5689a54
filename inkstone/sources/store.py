"""The tables of the application's store, kept as Parquet: users, progress, quotas, events, jobs.

A table lies in folders by a hash of its key.  A change reads and rewrites only the folders
of its keys: what they hold afterwards is written to the shared folder first, then those
folders are replaced by a dynamic partition overwrite, so what a change costs does not grow
with the table.  Events are only ever appended, by ingest.  One writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone import schemas
from inkstone.operators import behaviour
from inkstone.sources.stage import exists, settle

TABLES = {"users": schemas.USER, "reading_progress": schemas.PROGRESS, "ai_quota": schemas.QUOTA, "analytics_events": schemas.STORED_EVENT, "illustration_jobs": schemas.JOB}
#: The column that says in which folder a row lies.
KEYS = {"users": "email", "reading_progress": "user_id", "ai_quota": "quota_key", "illustration_jobs": "book_id"}


class Store:
    """Tables in a folder; buckets, the folders of a table, never change once it is written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, name: str, value: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(KEYS[name]) if value is None else value), F.lit(self.buckets)).cast("int")

    def _rows(self, name: str) -> DataFrame:
        """A table with the folder of each row; an empty one where nothing was written yet."""
        schema = f"{TABLES[name]}, bucket int"
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        if name != "analytics_events":
            return self._rows(name).drop("bucket")
        path = f"{self.path}/{name}"
        return behaviour.stored_events(self.spark, path) if exists(self.spark, path) else self.spark.createDataFrame([], TABLES[name])

    def read_key(self, name: str, value: str) -> DataFrame:
        """The rows of one key; other folders are not read."""
        return self._rows(name).where((F.col("bucket") == self._bucket(name, F.lit(value))) & (F.col(KEYS[name]) == value)).drop("bucket")

    def _change(self, name: str, touched: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the folders of touched, a column of their numbers, by what merged makes of their rows."""
        own = [r[0] for r in touched.distinct().collect()]
        if own:
            old = self._rows(name).where(F.col("bucket").isin(own)).drop("bucket")
            new = settle(merged(old).select(*old.columns, self._bucket(name).alias("bucket")))
            new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _upsert(self, name: str, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        rows = settle(rows.select(*self.read(name).columns))
        self._change(name, rows.select(self._bucket(name)), lambda old: merged(old, rows))

    def insert_users(self, rows: DataFrame) -> None:
        """New users, their addresses trimmed and in small letters; of those whose address is known none is added."""
        stored = rows.withColumns({"email": behaviour.address(F.col("email")), "name": F.nullif(F.trim("name"), F.lit(""))})
        self._upsert("users", stored, lambda old, new: behaviour.insert_unique(old, new, ["email"], "created_at"))

    def save_progress(self, rows: DataFrame) -> None:
        """Progress by user and book: the latest row replaces the others."""
        self._upsert("reading_progress", rows, behaviour.latest_progress)

    def use_quota(self, calls: DataFrame) -> None:
        """Calls (key, at) added to the counts of their keys and days."""
        added = behaviour.quota_counts(calls).withColumnRenamed("key", "quota_key")
        self._upsert("ai_quota", added, lambda old, new: old.unionByName(new).groupBy("quota_key", "day").agg(F.sum("count").alias("count")))

    def insert_events(self, batches: DataFrame, ingest: str) -> None:
        """The valid events of request bodies, appended; the same ingest again replaces what it wrote."""
        behaviour.append_events(batches, f"{self.path}/analytics_events", ingest)

    def insert_jobs(self, rows: DataFrame) -> None:
        """New jobs; one for each block and type."""
        self._upsert("illustration_jobs", rows, lambda old, new: behaviour.insert_unique(old, new, ["book_id", "block_id", "type"], "created_at"))

    def patch_jobs(self, patches: DataFrame) -> None:
        """Jobs after patches (job_id, patch_id, at, status, error, image_url): a null leaves the old value, the time always moves."""
        fields = ("status", "error", "image_url", "updated_at")
        new = settle(behaviour.job_state(patches).select(F.col("job_id").alias("id"), *(F.col(c).alias(f"_{c}") for c in fields)))
        touched = self._rows("illustration_jobs").join(new, "id", "left_semi").select("bucket")
        self._change("illustration_jobs", touched, lambda old: old.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}))
