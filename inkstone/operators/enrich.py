"""What is laid over parsed blocks: human corrections, illustrations, the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.operators.spans import dealt
from inkstone.schemas import HUMAN_REVIEW, LOW_CONFIDENCE, REVIEW_TYPES


def block_key() -> Column:
    """The key that names a block to overrides and illustrations."""
    return F.concat_ws(":", F.col("source_start").cast("string"), F.substring("content", 1, 10))


def _beside(blocks: DataFrame, side: DataFrame, tasks: int | None) -> DataFrame:
    """blocks with what side (_book, _key, ...) has for them; tasks: how many join, else the session's number.

    The key is made before the join, so contents that nobody asks for are not sent.
    """
    return blocks.withColumn("_own", block_key()).join(dealt(side, tasks, "_book", "_key"), (F.col("book_id") == F.col("_book")) & (F.col("_own") == F.col("_key")), "left")


def apply_overrides(blocks: DataFrame, overrides: DataFrame, tasks: int | None = None) -> DataFrame:
    """Blocks with corrected type and level; the level is replaced even by none, confidence becomes 1."""
    o = overrides.select(F.col("book_id").alias("_book"), F.col("key").alias("_key"), F.col("type").alias("_type"), F.col("level").alias("_level"))
    rows = _beside(blocks, o, tasks)
    hit = F.col("_key").isNotNull()
    rows = rows.withColumns(
        {
            "type": F.when(hit, F.col("_type")).otherwise(F.col("type")),
            "level": F.when(hit, F.col("_level")).otherwise(F.col("level")),
            "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")),
            "parser": F.when(hit, HUMAN_REVIEW).otherwise(F.col("parser")),
        }
    )
    return rows.select(*blocks.columns)


def save_overrides(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """overrides after changes (book_id, key, type, level, reviewed_at, remove): the last change of a key wins, unknown types are refused."""
    valid = changes.where((F.coalesce("book_id", F.lit("")) != "") & (F.coalesce("key", F.lit("")) != "") & (F.coalesce("remove", F.lit(False)) | F.col("type").isin(*REVIEW_TYPES)))
    last = valid.groupBy("book_id", "key").agg(F.max_by(F.struct("type", "level", "reviewed_at", "remove"), "reviewed_at").alias("c"))
    kept = overrides.join(last.select("book_id", "key"), ["book_id", "key"], "left_anti")
    added = last.where(~F.coalesce("c.remove", F.lit(False))).select("book_id", "key", "c.type", "c.level", "c.reviewed_at")
    return kept.unionByName(added.select(*kept.columns))


def review_queue(blocks: DataFrame, overrides: DataFrame, tasks: int | None = None) -> DataFrame:
    """Blocks of low confidence or already corrected, with the start of their neighbours' text."""
    order = Window.partitionBy("book_id").orderBy("block_seq")
    near = dealt(blocks, tasks, "book_id").withColumns(
        {
            "key": block_key(),
            "prev_content": F.coalesce(F.substring(F.lag("content").over(order), 1, 30), F.lit("")),
            "next_content": F.coalesce(F.substring(F.lead("content").over(order), 1, 30), F.lit("")),
        }
    )
    o = overrides.select("book_id", "key", F.col("type").alias("override_type"), F.col("level").alias("override_level"), F.lit(True).alias("applied"))
    rows = near.join(dealt(o, tasks, "book_id", "key"), ["book_id", "key"], "left").where((F.col("confidence") < LOW_CONFIDENCE) | F.col("applied"))
    return rows.select("book_id", "key", "block_id", "content", F.col("type").alias("rule_type"), F.col("level").alias("rule_level"), "confidence", "override_type", "override_level", "prev_content", "next_content")


def reviewed_books(overrides: DataFrame, entries: DataFrame) -> DataFrame:
    counts = overrides.groupBy("book_id").agg(F.count("*").alias("overrides"))
    return counts.join(entries.select(F.col("id").alias("book_id"), "title"), "book_id")


def inject_illustrations(blocks: DataFrame, illustrations: DataFrame, tasks: int | None = None) -> DataFrame:
    """Blocks with an image and its caption after each anchor; block_seq is numbered anew, ids and contents lists are not."""
    i = illustrations.where("position = 'after'").select(F.col("book_id").alias("_book"), F.col("key").alias("_key"), "image", "caption")
    rows = _beside(blocks, i, tasks)
    own = [c for c in blocks.columns if c not in ("book_id", "block_seq")]
    added = lambda kind, content, suffix: F.struct(
        F.concat("block_id", F.lit(suffix)).alias("block_id"), F.lit(kind).alias("type"), F.col(content).alias("content"), F.lit(None).cast("int").alias("level"), "source_start", "source_end", F.lit(1.0).alias("confidence"), F.lit("ritual-illus").alias("parser")
    )
    self = F.struct(*own)
    three = F.when(F.col("_key").isNotNull(), F.array(self, added("image", "image", "-illus"), added("image-caption", "caption", "-illus-cap"))).otherwise(F.array(self))
    rows = dealt(rows.select("book_id", "block_seq", F.posexplode(three).alias("_sub", "b")), tasks, "book_id")
    order = Window.partitionBy("book_id").orderBy("block_seq", "_sub")
    return rows.select("book_id", (F.row_number().over(order) - 1).alias("block_seq"), "b.*").select(*blocks.columns)
