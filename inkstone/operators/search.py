"""Full-text search: one scan, no index; variants of the query, first hit, count, snippet, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions.variants import query_variants
from inkstone.operators import catalog


def hits(docs: DataFrame, variants: list[str]) -> DataFrame:
    """Documents (id, title, content, ord ...) that hold a variant, with matched_term, pos (0-based), match_count, snippet, title_hit.

    The variant that occurs first counts, the earlier one of equals.  Terms are literals,
    and case matters.
    """
    return shown(_located(docs, variants))


def _located(docs: DataFrame, variants: list[str]) -> DataFrame:
    """hits with their content, without snippets: what ranking needs."""
    if not variants:
        return docs.limit(0).select("*", F.lit("").alias("matched_term"), F.lit(0).alias("pos"), F.lit(0).alias("match_count"), F.lit(False).alias("title_hit"))
    text = F.col("content")
    any_term = F.lit(False)
    for v in variants:
        any_term = any_term | F.contains(text, F.lit(v))
    found = [F.struct(F.instr(text, v).alias("pos"), F.lit(i).alias("i"), F.lit(v).alias("term")) for i, v in enumerate(variants)]
    first = F.array_min(F.filter(F.array(*found), lambda s: s["pos"] > 0))
    rows = docs.where(any_term).withColumn("_f", first)
    term, pos = F.col("_f.term"), F.col("_f.pos") - 1
    in_title = F.lit(False)
    for v in variants:
        in_title = in_title | F.coalesce(F.contains("title", F.lit(v)), F.lit(False))
    # Counting starts at the first hit; nothing stands before it.
    rows = rows.withColumns({"matched_term": term, "pos": pos, "match_count": T.occurrences(text, term), "title_hit": in_title})
    return rows.drop("_f")


def shown(located: DataFrame) -> DataFrame:
    """located rows with their snippets, without their content."""
    snippet = T.window_of(F.col("content"), F.col("pos"), F.length("matched_term"), 40, 40, True)
    return located.withColumn("snippet", snippet).drop("content")


def ranked(found: DataFrame) -> tuple[Column, ...]:
    """The order of results: title hits, then hits in the text, then the catalog's order."""
    return (F.col("title_hit").desc(), F.col("match_count").desc(), F.col("ord"))


def search(docs: DataFrame, variants: list[str], page: int = 1, size: int = 20) -> DataFrame:
    """One page of ranked hits; snippets are made for these alone."""
    found = _located(docs, variants)
    return shown(found.orderBy(*ranked(found)).offset(max(0, page - 1) * size).limit(size))


def after(docs: DataFrame, variants: list[str], last: tuple[bool, int, int] | None = None, size: int = 20) -> tuple[DataFrame, Observation]:
    """The page behind a cursor, the (title_hit, match_count, ord) of the last hit shown, and what will have counted all hits.

    The cursor filters before the best are taken, so a page far back gathers one page of
    rows.  The count ("total") is observed in the same pass and is there when the page is.
    """
    found = _located(docs, variants)
    seen = Observation()
    found = found.observe(seen, F.count("*").alias("total"))
    if last is not None:
        title, count, ord_ = (F.lit(x) for x in last)
        same_title, same_count = F.col("title_hit") == title, F.col("match_count") == count
        found = found.where((F.col("title_hit") < title) | (same_title & (F.col("match_count") < count)) | (same_title & same_count & (F.col("ord") > ord_)))
    return shown(found.orderBy(*ranked(found)).limit(size)), seen


def total(docs: DataFrame, variants: list[str]) -> DataFrame:
    return _located(docs, variants).agg(F.count("*").alias("total"))


def in_book(blocks: DataFrame, book_id: str, query: str, most: int = 50) -> DataFrame:
    """The first blocks of a book that hold the query: (block_seq, block_id, snippet)."""
    query = query.strip()
    rows = blocks.where((F.col("book_id") == book_id) & (F.lit(query) != "") & F.contains("content", F.lit(query)))
    pos = F.instr("content", query) - 1
    rows = rows.select("block_seq", "block_id", T.window_of(F.col("content"), pos, F.lit(len(query)), 12, 20, False).alias("snippet"))
    return rows.orderBy("block_seq").limit(most)


def highlight(text: Column, term: str) -> Column:
    """The pieces of a text between hits of a literal term; the whole text for an empty term."""
    return F.split(text, F.lit(_quoted(term))) if term else F.array(text)


def _quoted(term: str) -> str:
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def find(docs: DataFrame, query: str, page: int = 1, size: int = 20) -> DataFrame:
    """Full-text search for a query as typed: its variants are searched for together; nothing for a blank one."""
    return search(docs, query_variants(docs.sparkSession, query), page, size)


def dispatch(docs: DataFrame, query: str, mode: str = "full", page: int = 1, size: int = 20) -> DataFrame:
    """The search page for a query as typed: full text, or titles, authors and previews."""
    if mode == "full":
        return find(docs, query, page, size)
    return catalog.page(catalog.search(docs, query_variants(docs.sparkSession, query)), page, size, F.col("ord"))


def whole_text(blocks: DataFrame) -> DataFrame:
    """(book_id, text): all contents of a book, joined by line ends."""
    return _joined(blocks)


def visible_text(blocks: DataFrame, most: int = 6000) -> DataFrame:
    """(book_id, text): what a reader sees of a book, cut to `most` characters; blocks beyond them are not joined."""
    shown = blocks.where(F.col("type").isin("paragraph", "heading", "subheading", "annotation"))
    before = Window.partitionBy("book_id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, -1)
    # A block that begins right behind the cut still has its line end before it.
    near = shown.withColumn("_at", F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0))).where(F.col("_at") <= most)
    return _joined(near).withColumn("text", F.substring("text", 1, most))


def chapter(blocks: DataFrame, toc: DataFrame, book_id: str, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """A book's contents and its first blocks."""
    return toc.where(F.col("book_id") == book_id), blocks.where((F.col("book_id") == book_id) & (F.col("block_seq") < most))


def _joined(blocks: DataFrame) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_seq", "content"))), lambda x: x["content"])
    return blocks.groupBy("book_id").agg(F.array_join(parts, "\n").alias("text"))
