"""Behavioural data: events, reading progress, quotas, jobs, recent lists, chat history."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import json_text
from inkstone.functions import text as T
from inkstone.schemas import EVENT_NAMES, STORED_EVENT

MOST_EVENTS, USER_LIMIT, GUEST_LIMIT = 50, 50, 5


def _events(bodies: pd.Series) -> pd.Series:
    """The valid events of each body, none of a body that is refused."""

    def one(body):
        try:
            value = json_text.read(body) if body is not None else None
        except ValueError:
            return []
        items = value.get("events") if isinstance(value, dict) else value
        if not isinstance(items, list) or not 1 <= len(items) <= MOST_EVENTS:
            return []
        named = lambda e, k: json_text.text(e[k]) if isinstance(e.get(k), str) else None
        known = [(i, e) for i, e in enumerate(items) if isinstance(e, dict) and isinstance(e.get("event"), str) and e["event"] in EVENT_NAMES]
        # What a browser takes for false is not stored; an empty list or object is true.
        kept = lambda x: json_text.write(x) if x or isinstance(x, list | dict) else None
        return [{"place": i, "event": e["event"], "session_id": named(e, "sessionId"), "book_id": named(e, "bookId"), "extra_json": kept(e.get("extra"))} for i, e in known]

    return bodies.map(one)


def expand_batches(batches: DataFrame) -> DataFrame:
    """Events of request bodies (batch_id, body, user_id, user_agent, created_at): validated and normalised.

    A body is an array of events or an object with one; batches of 0 or over 50 items, and
    bodies that are no JSON, are refused whole; items that are no objects and unknown events
    are dropped; fields that are no strings become null.  id names an event by its batch
    and its place there.
    """
    found = F.pandas_udf(_events, "array<struct<place: int, event: string, session_id: string, book_id: string, extra_json: string>>")
    rows = batches.select("batch_id", "user_id", "user_agent", "created_at", F.explode(found("body")).alias("e"))
    return rows.select(
        F.concat_ws(":", "batch_id", F.col("e.place").cast("string")).alias("id"),
        "batch_id",
        "e.event",
        "user_id",
        "e.session_id",
        "e.book_id",
        F.substring("user_agent", 1, 120).alias("platform"),
        "e.extra_json",
        "created_at",
    )


def batch_status(batches: DataFrame) -> DataFrame:
    """(batch_id, stored, status): 400 for a batch that is refused or has no valid event."""
    stored = expand_batches(batches).groupBy("batch_id").agg(F.count("*").alias("stored"))
    rows = batches.select("batch_id").join(stored, "batch_id", "left")
    return rows.select("batch_id", F.coalesce("stored", F.lit(0)).alias("stored"), F.when(F.col("stored").isNull(), 400).otherwise(200).alias("status"))


def client_time(events: DataFrame) -> DataFrame:
    """events with client_ts, the time that the client noted, in milliseconds."""
    return events.withColumn("client_ts", F.get_json_object("extra_json", "$.ts").try_cast("long"))


def known_events(events: DataFrame, names: tuple[str, ...] = EVENT_NAMES) -> DataFrame:
    return events.where(F.col("event").isin(*names))


def daily_counts(events: DataFrame) -> DataFrame:
    day = F.date_format(F.timestamp_millis("created_at"), "yyyy-MM-dd")
    return events.groupBy(day.alias("day"), "event").agg(F.count("*").alias("n"))


def latest_progress(progress: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """One row per user and book, the latest; rows without a book id are refused."""
    rows = progress if updates is None else progress.unionByName(updates)
    rows = rows.where(F.coalesce("book_id", F.lit("")) != "")
    last = rows.groupBy("user_id", "book_id").agg(F.max_by(F.struct("data_json", "updated_at"), F.struct("updated_at", "data_json")).alias("p"))
    return last.select("user_id", "book_id", "p.data_json", "p.updated_at")


def progress_of(progress: DataFrame, user_id: str) -> DataFrame:
    """A user's progress, newest first."""
    return progress.where(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "book_id")


def running_duration(visits: DataFrame) -> DataFrame:
    """visits (user_id, book_id, at, visit_id, duration_ms) with total_ms, the time spent on the book so far."""
    order = Window.partitionBy("user_id", "book_id").orderBy("at", "visit_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return visits.withColumn("total_ms", F.sum("duration_ms").over(order))


def scroll_progress(page_index: Column, total_pages: Column) -> Column:
    return F.when(total_pages > 1, page_index / (total_pages - 1)).otherwise(0.0)


def resume_link() -> Column:
    """Where to go on reading: the page, else the block, else the book."""
    base = F.concat(F.lit("/text/"), F.col("book_id"))
    volume = F.when(F.coalesce("volume_block_id", F.lit("")) != "", F.concat(F.lit("&volume="), F.url_encode("volume_block_id"))).otherwise("")
    page = F.concat(base, F.lit("?page="), (F.col("page_index") + 1).cast("string"), volume)
    return F.when(F.coalesce(F.col("page_index") >= 0, F.lit(False)), page).when(F.coalesce("block_id", F.lit("")) != "", F.concat(base, F.lit("#"), F.col("block_id"))).otherwise(base)


def progress_label() -> Column:
    paged = F.col("page_index").isNotNull() & (F.coalesce("total_pages", F.lit(0)) != 0)
    return F.when(paged, F.format_string("第 %d/%d 页", (F.col("page_index") + 1).cast("long"), F.col("total_pages").cast("long"))).otherwise(F.concat(F.floor(F.col("scroll_progress") * 100 + 0.5).cast("string"), F.lit("%")))


def quota_key(user_id: Column, session_id: Column, ip: Column) -> Column:
    """user, else a named session, else a hash of the address."""
    guest = F.when(F.coalesce(session_id, F.lit("")).isin("", "anonymous"), F.concat(F.lit("ip:"), T.base36(F.abs(T.poly31(T.or_else(ip, F.lit("unknown"))))))).otherwise(F.concat(F.lit("anon:"), session_id))
    return F.when(F.coalesce(user_id, F.lit("")) != "", F.concat(F.lit("user:"), user_id)).otherwise(guest)


def quota_decisions(calls: DataFrame, limit: Column) -> DataFrame:
    """calls (key, at, call_id) with used before, allowed and remaining, by key and UTC day.

    Only allowed calls use quota, so a call's place in its day decides.
    """
    order = Window.partitionBy("key", "day").orderBy("at", "call_id")
    rows = calls.withColumn("day", F.date_format("at", "yyyy-MM-dd")).withColumn("_n", F.row_number().over(order)).withColumn("_limit", limit)
    return rows.select(*calls.columns, "day", F.least(F.col("_n") - 1, F.col("_limit")).alias("used"), (F.col("_n") <= F.col("_limit")).alias("allowed"), F.greatest(F.lit(0), F.col("_limit") - F.col("_n")).alias("remaining"))


def quota_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("key", F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("count"))


def job_state(patches: DataFrame) -> DataFrame:
    """The state of each job after its patches (job_id, at, status, error, image_url): a null field leaves the old value."""
    order = Window.partitionBy("job_id").orderBy("at", "patch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = patches.select("job_id", "at", "patch_id", *(F.last(c, ignorenulls=True).over(order).alias(c) for c in ("status", "error", "image_url")))
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("status", "error", "image_url"), F.struct("at", "patch_id")).alias("s"), F.max("at").alias("updated_at"))
    return last.select("job_id", "s.*", "updated_at")


def job_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (book_id, block_id, type) with what becomes of them: reuse a finished or running job, refuse one that failed, else insert."""
    rows = requests.withColumn("type", F.coalesce("type", F.lit("scene"))).join(jobs.select("book_id", "block_id", "type", F.col("id").alias("job_id"), "status", "image_url"), ["book_id", "block_id", "type"], "left")
    done = (F.col("status") == "done") & (F.coalesce("image_url", F.lit("")) != "")
    action = F.when(F.col("job_id").isNull(), "insert").when(done | F.col("status").isin("pending", "processing"), "reuse").otherwise("reject")
    return rows.withColumn("action", action)


def insert_unique(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """table and those rows whose key it lacks; of rows with one key the first by order."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return table.unionByName(first.join(table.select(*key), key, "left_anti").select(*table.columns))


def address(email: Column) -> Column:
    """An address as it is stored and looked up."""
    return F.lower(T.trim(email))


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.lower("email") == address(F.lit(email)))


def valid_registration(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows (email, password_length) with status 200, 400 for a bad address or short password, 409 for a known one."""
    known = users.select(address(F.col("email")).alias("_k")).distinct()
    mail = address(F.col("email"))
    out = rows.join(known, mail == F.col("_k"), "left")
    bad = ~F.coalesce(F.trim("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"), F.lit(False)) | (F.coalesce("password_length", F.lit(0)) < 6)
    return out.withColumn("status", F.when(bad, 400).when(F.col("_k").isNotNull(), 409).otherwise(200)).drop("_k")


def recent(items: DataFrame, key: str, at: str, most: int = 10) -> DataFrame:
    """Each key's latest items, newest first: rank 1 to most."""
    order = Window.partitionBy(key).orderBy(F.desc(at), "item_id")
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def last_messages(messages: DataFrame, most: int = 10) -> DataFrame:
    """The last messages of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def ring_neighbours(tracks: DataFrame) -> DataFrame:
    """(list_id, track_id, prev_id, next_id): the ends of a list meet."""
    order = Window.partitionBy("list_id").orderBy("place")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return tracks.select("list_id", "track_id", F.coalesce(F.lag("track_id").over(order), F.last("track_id").over(whole)).alias("prev_id"), F.coalesce(F.lead("track_id").over(order), F.first("track_id").over(whole)).alias("next_id"))


def user_by_id(users: DataFrame, user_id: str) -> DataFrame:
    return users.where(F.col("id") == user_id)


def progress_in(progress: DataFrame, user_id: str, book_id: str) -> DataFrame:
    return progress.where((F.col("user_id") == user_id) & (F.col("book_id") == book_id))


def quota_used(keys: DataFrame, counts: DataFrame, day: str) -> DataFrame:
    """keys with the calls counted on a day, 0 where there are none."""
    own = counts.where(F.col("day") == day).select("key", F.col("count").alias("used"))
    return keys.join(own, "key", "left").withColumn("used", F.coalesce("used", F.lit(0)))


def job_by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("id") == job_id)


def job_of_block(jobs: DataFrame, book_id: str, block_id: str, kind: str = "scene") -> DataFrame:
    return jobs.where((F.col("book_id") == book_id) & (F.col("block_id") == block_id) & (F.col("type") == kind))


def duplicates(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: empty where a unique index would hold."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def append_events(batches: DataFrame, path: str, ingest: str) -> None:
    """Append the valid events of request bodies to a table; the same `ingest` again replaces what it wrote, so a retry doubles nothing."""
    rows = expand_batches(batches).withColumn("ingest", F.lit(ingest))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest").parquet(path)


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of all ingests, each once."""
    return spark.read.schema(f"{STORED_EVENT}, ingest string").parquet(path).drop("ingest")
