"""The parsing quality of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.sources.stage import write_text
from inkstone.schemas import LOW_CONFIDENCE, PARSER_VERSION


def _low():
    return F.col("confidence") < LOW_CONFIDENCE


def by_type(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("type").agg(F.count("*").alias("blocks"), F.count_if(_low()).alias("low_confidence"))


def shapes(blocks: DataFrame, most: int = 40) -> DataFrame:
    """The commonest beginnings of low-confidence blocks; of equals the first met."""
    key = F.concat("type", F.lit(": "), F.substring("content", 1, 12))
    rows = blocks.where(_low()).groupBy(key.alias("shape")).agg(F.count("*").alias("n"), F.min(F.struct("book_id", "block_seq")).alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(most).select("shape", "n")


def worst_books(blocks: DataFrame, most: int = 20) -> DataFrame:
    rows = blocks.groupBy("book_id").agg(F.count_if(_low()).alias("low_confidence"), F.count("*").alias("total"))
    rows = rows.withColumn("ratio", F.col("low_confidence") / F.col("total"))
    return rows.orderBy(F.desc("ratio"), "book_id").limit(most).withColumn("share", T.percent(F.col("low_confidence"), F.col("total"))).drop("ratio")


def totals(blocks: DataFrame) -> DataFrame:
    rows = blocks.agg(F.count_distinct("book_id").alias("books"), F.count("*").alias("total_blocks"), F.count_if(_low()).alias("low_confidence"))
    return rows.withColumn("share", T.percent(F.col("low_confidence"), F.col("total_blocks")))


def write(blocks: DataFrame, entries: DataFrame, built: str, path: str) -> None:
    """The report as a file."""
    write_text(blocks.sparkSession, path, markdown(blocks, entries, built))


def markdown(blocks: DataFrame, entries: DataFrame, built: str) -> str:
    """The report as text; only its short tables are collected."""
    total = totals(blocks).head()
    number = "{:,}".format
    names = entries.select(F.col("id").alias("book_id"), "title")
    worst = worst_books(blocks).join(names, "book_id", "left").orderBy((F.col("low_confidence") / F.col("total")).desc(), "book_id").collect()
    out = ["# Parsing quality", "", f"- Built: {built}", f"- Parser: {PARSER_VERSION}", f"- Books parsed: {number(total['books'])} / {number(entries.count())}"]
    out += [f"- Blocks: {number(total['total_blocks'])}", f"- Low confidence: {number(total['low_confidence'])} ({total['share']})", "", "## Types", "", "| Type | Blocks | Low confidence |", "|---|---|---|"]
    out += [f"| {r['type']} | {number(r['blocks'])} | {number(r['low_confidence'])} |" for r in by_type(blocks).orderBy(F.desc("blocks"), "type").collect()]
    out += ["", "## Common shapes of low confidence", "", "| Shape | Times |", "|---|---|"]
    out += [f"| {r['shape'].replace('|', chr(92) + '|')} | {number(r['n'])} |" for r in shapes(blocks).collect()]
    out += ["", "## Books with the largest share", "", "| Book | Low / all | Share |", "|---|---|---|"]
    out += [f"| {r['title']} | {number(r['low_confidence'])}/{number(r['total'])} | {r['share']} |" for r in worst]
    return "\n".join([*out, ""])
