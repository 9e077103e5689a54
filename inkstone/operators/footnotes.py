"""Footnotes: definitions, references in running text, scopes by volume, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import spans
from inkstone.operators.parse import VOLUME_TAIL

#: Marks, and the longer prefix that a volume's name may have here.
MARK = r"[#＃](\d+)"
DEFINITION = rf"^{T.SPACE}*((?:[#＃]\d+)+)"
SCOPE = rf"^.{{0,20}}?{VOLUME_TAIL}\z"
SEGMENT = r"[#＃]\d+|(?:(?![#＃]\d)[\s\S])+"


def is_definition(content: Column) -> Column:
    return content.rlike(DEFINITION)


def numbers(source: Column) -> Column:
    """The numbers of all marks; those beyond 18 digits are null."""
    return F.transform(F.regexp_extract_all(source, F.lit(MARK), 1), lambda d: F.when(F.length(d) <= 18, d.cast("long")))


def definition(content: Column) -> Column:
    """Struct of a definition's numbers and body; null for other text."""
    head = F.regexp_extract(content, DEFINITION, 0)
    # Only the left end is trimmed.
    body = F.regexp_replace(F.substring(content, F.length(head) + 1, F.length(content)), rf"^{T.SPACE}+", "")
    return F.when(is_definition(content), F.struct(numbers(head).alias("nums"), body.alias("body")))


def segments(content: Column) -> Column:
    """Array of (kind, value, num): text and references in order, no empty text."""
    parts = F.regexp_extract_all(content, F.lit(SEGMENT), 0)
    is_ref = lambda v: v.rlike(rf"^{MARK}\z")
    return F.transform(parts, lambda v: F.struct(F.when(is_ref(v), "ref").otherwise("text").alias("kind"), v.alias("value"), F.when(is_ref(v) & (F.length(v) <= 19), F.substring(v, 2, 20).cast("long")).alias("num")))


def with_scope(blocks: DataFrame, whole: bool | None = None, tasks: int | None = None) -> DataFrame:
    """blocks with scope: the number of volume headings so far."""
    opens = (F.col("type") == "heading") & (F.col("level") == 2) & F.col("content").rlike(SCOPE)
    rows = spans.sum_before(blocks, "book_id", "block_seq", "scope", F.when(opens, 1).otherwise(0), here=True, whole=whole, tasks=tasks)
    return rows.withColumn("scope", F.col("scope").cast("int"))


def index(scoped: DataFrame) -> DataFrame:
    """(book_id, scope, num, def_block_id); of several definitions of a number the last counts."""
    rows = scoped.where(is_definition(F.col("content"))).select("book_id", "scope", "block_seq", "block_id", F.explode(definition(F.col("content"))["nums"]).alias("num"))
    return rows.where("num is not null").groupBy("book_id", "scope", "num").agg(F.max_by("block_id", "block_seq").alias("def_block_id"))


def references(scoped: DataFrame) -> DataFrame:
    """(book_id, scope, block_id, ref_seq, num) of the references in blocks that are no definitions."""
    rows = scoped.where(~is_definition(F.col("content")) & F.col("content").rlike(MARK))
    found = rows.select("book_id", "scope", "block_id", F.posexplode(F.filter(segments(F.col("content")), lambda s: s["kind"] == "ref")).alias("ref_seq", "s"))
    return found.select("book_id", "scope", "block_id", "ref_seq", F.col("s.num").alias("num"))


def resolve(scoped: DataFrame) -> DataFrame:
    """references with def_block_id, null for an orphan."""
    return references(scoped).join(index(scoped), ["book_id", "scope", "num"], "left")


def orphans(scoped: DataFrame) -> DataFrame:
    return references(scoped).join(index(scoped), ["book_id", "scope", "num"], "left_anti")


def display_type(blocks: DataFrame) -> DataFrame:
    """blocks with display: a definition is shown as a footnote whatever its type."""
    return blocks.withColumn("display", F.when(is_definition(F.col("content")), "footnote").otherwise(F.col("type")))


def counts(scoped: DataFrame) -> DataFrame:
    """(book_id, resolved, orphans) of the books with references."""
    return resolve(scoped).groupBy("book_id").agg(F.count("def_block_id").alias("resolved"), F.count_if(F.col("def_block_id").isNull()).alias("orphans"))
