"""Pages of whole blocks, and what is looked up by page: volume, contents, scroll position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.operators import spans
from inkstone.operators.parse import in_contents
from inkstone.sources.stage import settle

#: Characters of a page from which a heading starts the next, and at which it ends anyway.
TARGET, MOST = 1400, 2200
#: Characters of a book that one task cuts.
REACH = 400_000


def _next_starts(blocks: DataFrame, reach: int, whole: bool, tasks: int) -> DataFrame:
    """(book_id, part, block_seq, next): where the page that a block starts ends, the next page's first block.

    That depends on the characters from the block on alone: the next heading with which they
    reach TARGET starts a page, or the block behind the one with which they reach MOST.  Blocks
    stand at the characters before them, so both are found by windows over a range of
    characters; parts of `reach` characters, with what begins within MOST behind them and
    the block behind a long one, are dealt apart.
    """
    head = F.col("type").isin("heading", "subheading")
    rows = blocks.select("book_id", "block_seq", F.length("content").cast("long").alias("n"), head.alias("head"))
    rows = spans.sum_before(rows, "book_id", "block_seq", "at", F.col("n"), whole=whole, tasks=tasks)
    part = F.floor(F.col("at") / reach).cast("long")
    halo = F.floor(F.greatest(F.lit(0), F.col("at") - MOST) / reach).cast("long")
    rows = rows.withColumns({"own": part, "halo": halo})
    long = rows.where(F.col("n") > MOST).select("book_id", (F.col("block_seq") + 1).alias("block_seq"), F.col("own").alias("part"))
    behind = rows.join(spans.dealt(long, tasks, "book_id", "block_seq"), ["book_id", "block_seq"]).where(F.col("part") < F.col("halo"))
    rows = spans.dealt(rows.select("*", F.explode(F.sequence("halo", "own")).alias("part")).unionByName(behind), tasks, "book_id", "part")
    # Each block is a place where a page can start, and one where the characters before the next block are reached.
    start = F.struct(F.col("at").alias("x"), F.lit(None).cast("int").alias("reached"), F.lit(None).cast("int").alias("reached_head"))
    point = F.struct((F.col("at") + F.col("n")).alias("x"), F.col("block_seq").alias("reached"), F.when(F.col("head"), F.col("block_seq")).alias("reached_head"))
    both = rows.select("book_id", "part", "own", "block_seq", "head", F.explode(F.array(start, point)).alias("e")).select("*", "e.*")
    by = Window.partitionBy("book_id", "part")
    beyond = lambda chars: by.orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, -chars)
    both = both.withColumns({"full": F.min("reached").over(beyond(MOST)), "marked": F.min("reached_head").over(beyond(TARGET))})
    starts = both.where(F.col("reached").isNull())
    after = by.orderBy(F.desc("block_seq")).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("head_after", F.min(F.when(F.col("head"), F.col("block_seq"))).over(after))
    # A page has a block at least, however long that is.
    full = F.when(F.col("full").isNotNull(), F.greatest("full", F.col("block_seq") + 1))
    marked = F.when(F.col("marked") == F.col("block_seq"), F.col("head_after")).otherwise(F.col("marked"))
    cut = F.when(F.coalesce(marked <= full, marked.isNotNull()), marked).otherwise(full + 1)
    return starts.where(F.col("part") == F.col("own")).select("book_id", "part", "block_seq", cut.alias("next"))


def _walk(steps: Column, start: Column) -> Column:
    """(places, next): the starts met when the steps (block_seq, next), in order, are followed from start on, and where they lead out."""
    none = F.struct(F.array().cast("array<int>").alias("places"), start.cast("int").alias("next"))
    return F.aggregate(steps, none, lambda a, x: F.when(x["block_seq"] == a["next"], F.struct(F.concat(a["places"], F.array(x["block_seq"])).alias("places"), x["next"].alias("next"))).otherwise(a))


def page_starts(blocks: DataFrame, reach: int = REACH, whole: bool | None = None, tasks: int | None = None) -> DataFrame:
    """(book_id, block_seq) of the first block of every page.

    Inside a part the starts are a walk along _next_starts, and a book of one part is that
    walk from its first block.  Where a book has several parts,
    each is walked from every block that an earlier part can lead to, a few at its beginning,
    and pointers from part to part are doubled until all that a book's first block leads to
    are known: as many joins as the logarithm of the parts, over a row for each such block.
    """
    if whole is None or tasks is None:
        whole, tasks = spans.measured(blocks)
    steps = F.array_sort(F.collect_list(F.struct("block_seq", "next")))
    parts = _next_starts(blocks, reach, whole, tasks).groupBy("book_id", "part").agg(steps.alias("steps"))
    book, end = Window.partitionBy("book_id"), lambda k: F.element_at("steps", k)["block_seq"]
    parts = spans.dealt(parts.withColumns({"lo": end(1), "hi": end(-1)}), tasks, "book_id")
    parts = settle(parts.withColumns({"n": F.count("*").over(book), "begin": F.min("lo").over(book)}))
    alone = parts.where("n = 1").select("book_id", F.explode(_walk(F.col("steps"), F.col("lo"))["places"]).alias("block_seq"))
    parts = parts.where("n > 1")
    if parts.isEmpty():
        return alone
    nexts = parts.select("book_id", "part", F.explode("steps.block_seq").alias("entry"))
    begin = parts.select("book_id", F.col("begin").alias("entry")).distinct()
    out = F.array_distinct(F.filter("steps.next", lambda x: x > F.col("hi")))
    entries = begin.unionByName(parts.select("book_id", F.explode(out).alias("entry"))).distinct()
    lead = nexts.join(spans.dealt(entries, tasks, "book_id", "entry"), ["book_id", "entry"])
    walked = lead.join(parts.select("book_id", "part", "steps"), ["book_id", "part"]).select("book_id", "entry", _walk(F.col("steps"), F.col("entry")).alias("w"))
    walked = settle(walked.select("book_id", "entry", "w.places", F.col("w.next").alias("to")))
    reached = begin
    # The last page of a book leads nowhere.
    hops = walked.select("book_id", "entry", "to").join(walked.select("book_id", F.col("entry").alias("to")), ["book_id", "to"], "left_semi")
    more = settle(reached.join(hops, ["book_id", "entry"]).select("book_id", F.col("to").alias("entry")))
    while not more.isEmpty():
        reached = settle(reached.unionByName(more).distinct())
        far = hops.select("book_id", F.col("entry").alias("to"), F.col("to").alias("_far"))
        hops = settle(hops.join(far, ["book_id", "to"]).select("book_id", "entry", F.col("_far").alias("to")))
        more = settle(reached.join(hops, ["book_id", "entry"]).select("book_id", F.col("to").alias("entry")).join(reached, ["book_id", "entry"], "left_anti").distinct())
    return alone.unionByName(walked.join(reached, ["book_id", "entry"]).select("book_id", F.explode("places").alias("block_seq")))


def assign_pages(blocks: DataFrame, reach: int = REACH, rows: DataFrame | None = None) -> DataFrame:
    """blocks with page_index (0-based); rows: what of the blocks is wanted, if not all.

    The page starts are laid between the blocks and counted, so blocks are dealt once, by book.
    """
    rows = blocks if rows is None else rows
    whole, tasks = spans.measured(blocks)
    starts = page_starts(blocks, reach, whole, tasks).withColumn("_start", F.lit(1))
    both = rows.withColumn("_start", F.lit(0)).unionByName(starts, allowMissingColumns=True)
    both = spans.sum_before(both, "book_id", "block_seq", "page_index", F.col("_start"), here=True, whole=whole, tasks=tasks)
    return both.where("_start = 0").withColumn("page_index", (F.col("page_index") - 1).cast("int")).select(*rows.columns, "page_index")


def pages(books: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book_id, page_index, start_block, end_block, block_ids, char_count); a book without blocks has one empty page.

    Where blocks tell their volume, so does a page, that of its first block.  Blocks that
    tell their page are taken by it.
    """
    told = [c for c in ("volume_block_id", "page_index") if c in blocks.columns]
    rows = blocks.select("book_id", "block_seq", "block_id", F.length("content").alias("_chars"), *told)
    paged = rows if "page_index" in told else assign_pages(blocks, rows=rows)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("block_seq", "block_id"))), lambda x: x["block_id"])
    volume = [F.min_by("volume_block_id", "block_seq").alias("volume_block_id")] if "volume_block_id" in blocks.columns else []
    found = paged.groupBy("book_id", "page_index").agg(F.min("block_seq").alias("start_block"), F.max("block_seq").alias("end_block"), ids.alias("block_ids"), F.sum("_chars").alias("char_count"), *volume)
    zero = lambda name, kind="int": F.coalesce(name, F.lit(0)).cast(kind).alias(name)
    rows = books.select("book_id").distinct().join(found, "book_id", "left")
    return rows.select("book_id", zero("page_index"), zero("start_block"), zero("end_block"), F.coalesce("block_ids", F.array().cast("array<string>")).alias("block_ids"), zero("char_count", "bigint"), *(["volume_block_id"] if volume else []))


def with_volume(blocks: DataFrame, whole: bool | None = None, tasks: int | None = None) -> DataFrame:
    """blocks with the volume they stand in: the last contents item of level 2 so far, else the first of level 1.

    What is a contents item shows in the block itself, so nothing is joined.
    """
    at = lambda level, value: F.when(in_contents() & (F.coalesce("level", F.lit(3)) == level), value)
    both = F.struct("block_id", "content")
    if whole is None:
        whole, tasks = spans.measured(blocks)
    rows = spans.seen(blocks, "book_id", "block_seq", {"_two": at(2, both)}, {"_one": at(1, both)}, whole=whole, tasks=tasks)
    here = F.coalesce("_two", "_one")
    return rows.select(*blocks.columns, here["block_id"].alias("volume_block_id"), here["content"].alias("volume_title"))


def enrich_toc(toc: DataFrame, paged: DataFrame, tasks: int | None = None) -> DataFrame:
    """Contents items with page_index (0-based, 0 if unknown) and page_id (1-based)."""
    rows = spans.dealt(toc, tasks, "book_id", "block_id").join(paged.select("book_id", "block_id", "page_index"), ["book_id", "block_id"], "left")
    return rows.withColumn("page_index", F.coalesce("page_index", F.lit(0))).withColumn("page_id", F.col("page_index") + 1)


def active_item(page_rows: DataFrame, toc: DataFrame, tasks: int | None = None) -> DataFrame:
    """(book_id, page_index, active_block_id): the last contents item at or before a page's start, else the first."""
    marks = toc.select("book_id", F.col("block_seq").alias("at"), "block_id", F.lit(None).cast("int").alias("page_index"))
    asks = page_rows.select("book_id", F.col("start_block").alias("at"), F.lit(None).cast("string").alias("block_id"), "page_index")
    order = Window.partitionBy("book_id").orderBy("at", F.col("page_index").isNotNull())
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.coalesce(F.last("block_id", ignorenulls=True).over(so_far), F.first("block_id", ignorenulls=True).over(whole))
    return spans.dealt(marks.unionByName(asks), tasks, "book_id").withColumn("active_block_id", found).where("page_index is not null").select("book_id", "page_index", "active_block_id")


def toc_parents(toc: DataFrame) -> DataFrame:
    """(book_id, block_id, parent_id): the nearest earlier item of a smaller level.

    Levels are 1 to 3, so the last item of each smaller level is carried along; the later
    of them is the parent.
    """
    order = Window.partitionBy("book_id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.last(F.when(F.col("level") == n, F.struct("block_seq", "block_id")), ignorenulls=True).over(order) for n in (1, 2)}
    rows = toc.withColumns({"l1": last[1], "l2": last[2]})
    best = F.when(F.col("level") == 3, F.when(F.col("l2.block_seq") > F.coalesce("l1.block_seq", F.lit(-1)), F.col("l2.block_id")).otherwise(F.col("l1.block_id"))).when(F.col("level") == 2, F.col("l1.block_id"))
    return rows.select("book_id", "block_id", best.alias("parent_id"))


def page_from_scroll(progress: Column, total: Column) -> Column:
    return F.when(total <= 1, 0).otherwise(F.least(total - 1, F.greatest(F.lit(0), F.floor(progress * total)))).cast("int")


def fetch_page(page_rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers to requests (request_id, book_id, page_num, volume): status, neighbours and the page's range.

    page_num is 1-based: below 1 is status 400, an unknown book or page 404, a volume that
    the page does not stand in 409.  page_rows tell their volume.
    """
    totals = page_rows.groupBy("book_id").agg(F.count("*").alias("total_pages"))
    at = page_rows.select("book_id", (F.col("page_index") + 1).alias("page_num"), "start_block", "end_block", "char_count", "volume_block_id")
    rows = requests.join(totals, "book_id", "left").join(at, ["book_id", "page_num"], "left")
    status = (
        F.when(F.coalesce(F.col("page_num") < 1, F.lit(True)), 400)
        .when(F.col("end_block").isNull(), 404)
        .when(F.col("volume").isNotNull() & F.coalesce(F.col("volume") != F.col("volume_block_id"), F.lit(True)), 409)
        .otherwise(200)
    )
    rows = rows.withColumn("status", status)
    ok = F.col("status") == 200
    return rows.select(
        "request_id",
        "book_id",
        "page_num",
        "status",
        F.when(ok & (F.col("page_num") > 1), F.col("page_num") - 1).alias("prev_page"),
        F.when(ok & (F.col("page_num") < F.col("total_pages")), F.col("page_num") + 1).alias("next_page"),
        *(F.when(ok, F.col(c)).alias(c) for c in ("start_block", "end_block", "char_count", "total_pages")),
    )


def toc_ancestors(toc: DataFrame) -> DataFrame:
    """(book_id, block_id, path): the ids from the outermost item down to each; three levels need two look-ups."""
    up = toc_parents(toc)
    above = up.select("book_id", F.col("block_id").alias("parent_id"), F.col("parent_id").alias("_g"))
    rows = up.join(above, ["book_id", "parent_id"], "left")
    return rows.select("book_id", "block_id", F.concat_ws(">", "_g", "parent_id", "block_id").alias("path"))


def toc_answer(toc: DataFrame, page_rows: DataFrame) -> DataFrame:
    """(book_id, total_pages, items) of every book, without contents too."""
    pages_of = page_rows.groupBy("book_id").agg(F.count("*").alias("total_pages"))
    items = toc.groupBy("book_id").agg(F.count("*").alias("items"))
    return pages_of.join(items, "book_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def fetch_page_at(page_rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers to 0-based requests (request_id, book_id, page_index): 400 below 0, 404 for an unknown book or page."""
    totals = page_rows.groupBy("book_id").agg(F.count("*").alias("total_pages"))
    rows = requests.join(totals, "book_id", "left").join(page_rows.select("book_id", "page_index", "start_block", "end_block"), ["book_id", "page_index"], "left")
    status = F.when(F.coalesce(F.col("page_index") < 0, F.lit(True)), 400).when(F.col("end_block").isNull(), 404).otherwise(200)
    return rows.select("request_id", "book_id", "page_index", status.alias("status"), "start_block", "end_block", "total_pages")
