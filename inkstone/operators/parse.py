"""Structural parsing: lines become typed blocks with a confidence, blocks a table of contents.

Every rule looks at one line, except the title (the first line with text), runs of verse
and the numbers of blocks.  A book's lines are dealt in segments, so the one exchange moves
texts by book and segment; rules and all windows share its partitioning, and a book of any
size is spread over the cluster.  Of books with several segments each is summed up in a row
(its first text, the verse at both ends), a scan over those rows tells every segment what
it stands in, and a second one how many blocks come before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.schemas import LOW_CONFIDENCE, PARSER_VERSION

#: Numerals, and the shapes of lines by rule.
NUMERAL = "[一二三四五六七八九十百千0-9０-９]+"
VOLUME_TAIL = f"卷(之{NUMERAL}|{NUMERAL}|[上中下])"
VOLUME = rf"^.{{0,16}}?{VOLUME_TAIL}\z"
VOLUME_END = rf"^.{{0,16}}?{VOLUME_TAIL}竟\z"
EDITOR_NOTE = r"^(經名|经名|底本出處|底本出处)[：:]"
VERSE = rf"^{T.CJK}{{4,10}}[，、。]?\z"
CONTINUATION = r"^[又右訖畢終终]\z"
SAYS = rf"^{T.CJK}{{0,6}}曰[：:]?\z"
SEQUENCE = rf"^其{NUMERAL}\z"
SECTIONS = ("目錄", "目录", "附錄", "附录", "譯文", "译文", "告文", "附方", "序", "跋", "凡例", "原序", "後序", "后序", "自序", "原跋")
DIRECTIVE = rf"^{T.CJK}{{2,14}}(如法|如式|如常式|如上法)\z"
AUTHOR_LINE = rf"^{T.CJK}{{2,12}}(道士|真人|先生|居士|弟子|法師|天師){T.CJK}{{1,8}}(學|撰|註|注|集|編|纂|述|校|錄|疏|解)\z"
STOPS = r"[。？！；，、]"
STRONG_END = r"[品篇章訣诀符圖图讚赞頌颂咒呪誥诰]\z"


#: Lines of a segment: what a task reads of one book at once.
SEGMENT = 20_000
#: Characters that a task parses, about: tasks are more for more text, so what one sorts stays the same.
SHARE = 16_000_000


def measured(books: DataFrame, segment: int = SEGMENT) -> tuple[bool, int]:
    """Whether every book is one segment, which saves exchanges, and how many tasks shall parse: a look at line ends and lengths alone."""
    ends = F.length("source") - F.length(F.replace("source", F.lit("\n"), F.lit("")))
    most, chars = books.agg(F.max(ends), F.sum(F.length("source") + F.coalesce(F.length("title"), F.lit(0)))).head()
    return (most or 0) < segment, max(books.sparkSession.sparkContext.defaultParallelism, -(-(chars or 0) // SHARE))


def fits(books: DataFrame, segment: int = SEGMENT) -> bool:
    """Whether every book is one segment."""
    return measured(books, segment)[0]


def source_lines(books: DataFrame, segment: int = SEGMENT, whole: bool = False, tasks: int | None = None) -> DataFrame:
    """(book_id, title, segments, segment, idx, text, indented) of every line, text trimmed; a null source counts as empty.

    Books are dealt by their segments while those are one text each: what is sent is smaller
    than lines with their rules, and all windows over a segment find it in place.  whole:
    every book is one segment, and is dealt by its id.  tasks: to how many they are dealt,
    else the session's number.
    """
    to = () if tasks is None else (tasks,)
    if whole:
        rows = books.repartition(*to, "book_id").select("book_id", "title", F.lit(1).alias("segments"), F.lit(0).alias("segment"), F.posexplode(T.lines(F.coalesce("source", F.lit("")))).alias("at", "line"))
    else:
        rows = books.select("book_id", "title", T.lines(F.coalesce("source", F.lit(""))).alias("lines"))
        rows = rows.withColumn("segments", F.ceil(F.size("lines") / segment).cast("int"))
        part = F.transform(F.sequence(F.lit(0), F.col("segments") - 1), lambda k: F.when(F.col("segments") == 1, F.col("lines")).otherwise(F.slice("lines", k * segment + 1, segment)))
        rows = rows.select("book_id", "title", "segments", F.posexplode(part).alias("segment", "lines")).repartition(*to, "book_id", "segment")
        rows = rows.select("book_id", "title", "segments", "segment", F.posexplode("lines").alias("at", "line"))
    return rows.select("book_id", "title", "segments", "segment", (F.col("segment") * segment + F.col("at")).alias("idx"), T.trim("line").alias("text"), F.col("line").rlike(rf"^{T.SPACE}*\x{{3000}}").alias("indented"))


def _rule(text: Column, free: Column) -> Column:
    """(type, confidence, level) of a line that is neither title nor verse; free: not indented."""
    n = F.length(text)
    out = lambda kind, confidence, level=None: F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(level).cast("int").alias("level"))
    return (
        F.when(text.rlike(EDITOR_NOTE), out("editor-note", 0.9))
        .when(free & (n <= 24) & text.rlike(VOLUME_END), out("original-note", 0.9))
        .when(free & (n <= 20) & text.rlike(VOLUME), out("heading", 0.9, 2))
        .when(free & text.rlike(CONTINUATION), out("paragraph", 0.85))
        .when(free & (text.rlike(SAYS) | text.rlike(SEQUENCE)), out("subheading", 0.85, 4))
        .when(free & text.isin(*SECTIONS), out("subheading", 0.9, 3))
        .when(free & (n <= 16) & text.rlike(DIRECTIVE), out("annotation", 0.8))
        .when(free & (n <= 20) & text.rlike(AUTHOR_LINE), out("original-note", 0.8))
        .when(free & n.between(1, 16) & ~text.rlike(STOPS) & text.rlike(STRONG_END), out("subheading", 0.8, 3))
        .when(free & n.between(1, 16) & ~text.rlike(STOPS), out("subheading", 0.65, 3))
        .otherwise(out("paragraph", 0.98))
    )


def _own() -> WindowSpec:
    return Window.partitionBy("book_id", "segment")


def _shaped(lines: DataFrame) -> DataFrame:
    """lines with verse, whether one has the shape of verse, and taken, whether an earlier rule takes it before a run of verse can start with it."""
    text, free = F.col("text"), ~F.col("indented")
    taken = free & ((F.length(text) <= 24) & text.rlike(VOLUME_END) | (F.length(text) <= 20) & text.rlike(VOLUME))
    return lines.withColumns({"verse": free & text.rlike(VERSE), "taken": taken})


def _runs(rows: DataFrame) -> DataFrame:
    """rows with is_title, in_verse, lo and hi, the run of verse that a line stands in, and end, the last line of the segment.

    A run is one block from its first line that nothing else takes, if a line of verse
    follows there.  first: the book's first line with text, where it has several segments;
    lo_before: where a run starts that comes from the segments before; hi_after: where one
    ends that goes on behind this segment.
    """
    ordered = _own().orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text, idx = F.col("text"), F.col("idx")
    first = F.coalesce("first", F.min(F.when(text != "", idx)).over(_own()))
    rows = rows.withColumns({"is_title": F.coalesce(idx == first, F.lit(False)), "island": F.sum(F.when(F.col("verse"), 0).otherwise(1)).over(ordered), "end": F.max("idx").over(_own())})
    run = Window.partitionBy("book_id", "segment", "island")
    starts = F.min(F.when(F.col("verse") & ~F.col("is_title") & ~F.col("taken"), idx)).over(run)
    last = F.max(F.when(F.col("verse"), idx)).over(run)
    rows = rows.withColumns({"lo": F.when((F.col("island") == 0) & F.col("lo_before").isNotNull(), F.col("lo_before")).otherwise(starts), "hi": F.when((last == F.col("end")) & F.col("hi_after").isNotNull(), F.col("hi_after")).otherwise(last)})
    return rows.withColumn("in_verse", F.coalesce(F.col("verse") & (idx >= F.col("lo")) & (F.col("hi") > F.col("lo")), F.lit(False)))


def _kept() -> Column:
    """Whether a line begins a block."""
    return (F.col("text") != "") & (~F.col("in_verse") | (F.col("idx") == F.col("lo")))


def _joined(rows: DataFrame) -> DataFrame:
    """(book_id, segment, first, lo_before, hi_after, blocks_before, rest): what each segment of a book with several needs to know of the others.

    rest: the text of a run of verse that goes on behind the segment where it starts.
    """
    idx = F.col("idx")
    opening = F.min(F.when(F.col("text") != "", idx)).over(_own())
    marked = rows.withColumns({"broken": F.max(F.when(~F.col("verse"), idx)).over(_own()), "opening": opening})
    start = F.col("verse") & ~F.col("taken") & (idx > F.coalesce("broken", F.lit(-1)))
    sums = marked.groupBy("book_id", "segment").agg(
        F.min("opening").alias("opening"), F.max("broken").alias("broken"),
        F.coalesce(F.min(F.when(~F.col("verse"), idx)) - 1, F.max("idx")).alias("lead"), F.min("idx").alias("begin"),
        F.min(F.when(start, idx)).alias("lo"), F.min(F.when(start & (idx != F.coalesce("opening", F.lit(-1))), idx)).alias("lo_untitled"),
    )
    book = Window.partitionBy("book_id")
    first = F.min("opening").over(book)
    sums = sums.withColumn("first", first).withColumns({"lo": F.when(F.col("opening") == F.col("first"), F.col("lo_untitled")).otherwise(F.col("lo")), "lead": F.when(F.col("lead") >= F.col("begin"), F.col("lead"))})
    # Segments of nothing but verse hand on what comes to them, from either side.
    up, down = book.orderBy("segment"), book.orderBy(F.desc("segment"))
    broken = F.col("broken").isNotNull().cast("int")
    sums = sums.withColumns({"up": F.sum(broken).over(up), "down": F.sum(broken).over(down)})
    sums = sums.withColumns({"lo": F.first("lo", ignorenulls=True).over(Window.partitionBy("book_id", "up").orderBy("segment")), "lead": F.max("lead").over(Window.partitionBy("book_id", "down").orderBy(F.desc("segment")))})
    known = sums.select("book_id", "segment", "first", F.lag("lo").over(up).alias("lo_before"), F.lead("lead").over(up).alias("hi_after"))
    own = _runs(rows.join(known, ["book_id", "segment"]))
    counts = own.groupBy("book_id", "segment").agg(F.count_if(_kept()).alias("n"))
    counts = counts.withColumn("blocks_before", F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    beyond = own.where(F.col("in_verse") & (F.col("lo") == F.col("lo_before")))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    rest = beyond.groupBy("book_id", "lo").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("rest"))
    where = own.where(F.col("in_verse") & (F.col("idx") == F.col("lo")) & (F.col("hi") > F.col("end"))).select("book_id", "segment", "lo")
    rest = where.join(rest, ["book_id", "lo"]).select("book_id", "segment", "rest")
    return known.join(counts.drop("n"), ["book_id", "segment"]).join(rest, ["book_id", "segment"], "left")


def parse_lines(lines: DataFrame, whole: bool = False) -> DataFrame:
    """Blocks of the lines that source_lines gives."""
    text = F.col("text")
    # What is asked of the title is answered first, and rules come last: windows sort neither.
    same = (F.coalesce("title", F.lit("")) != "") & (F.contains(text, F.col("title")) | F.contains("title", text))
    rows = _shaped(lines).withColumn("same", same).drop("title")
    if whole:
        rows = rows.withColumns({**{c: F.lit(None).cast("int") for c in ("first", "lo_before", "hi_after", "blocks_before")}, "rest": F.lit(None).cast("string")})
    else:
        rows = rows.join(_joined(rows.where("segments > 1")), ["book_id", "segment"], "left")
    rows = _runs(rows)
    whole = Window.partitionBy("book_id", "segment", "island").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("joined", F.when(F.col("in_verse"), F.array_join(F.collect_list(F.when(F.col("in_verse"), text)).over(whole), "\n")))
    rows = rows.withColumn("joined", F.when(F.col("hi") > F.col("end"), F.concat_ws("\n", "joined", "rest")).otherwise(F.col("joined")))
    kept = rows.where(_kept())
    title, verse = F.col("is_title"), F.col("in_verse")
    seq = F.row_number().over(_own().orderBy("idx")) - 1 + F.coalesce("blocks_before", F.lit(0))
    return kept.withColumn("block_seq", seq).withColumn("rule", _rule(text, ~F.col("indented"))).select(
        "book_id",
        "block_seq",
        F.concat("book_id", F.lit("-b"), F.col("block_seq").cast("string")).alias("block_id"),
        F.when(title, "heading").when(verse, "verse").otherwise(F.col("rule.type")).alias("type"),
        F.when(verse, F.col("joined")).otherwise(text).alias("content"),
        F.when(title, 1).when(~verse, F.col("rule.level")).alias("level"),
        F.col("idx").alias("source_start"),
        F.when(verse, F.col("hi")).otherwise(F.col("idx")).alias("source_end"),
        F.when(title, F.when(F.col("same"), 0.95).otherwise(0.8)).when(verse, 0.5).otherwise(F.col("rule.confidence")).alias("confidence"),
        F.lit(PARSER_VERSION).alias("parser"),
    )


def parse(books: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Blocks of books (book_id, title, source), in the columns of schemas.BLOCK; they don't depend on the size of segments."""
    whole, tasks = measured(books, segment)
    return parse_lines(source_lines(books, segment, whole, tasks), whole)


def in_contents() -> Column:
    """Whether a block is an item of the contents: a heading down to level 3."""
    return F.col("type").isin("heading", "subheading") & (F.col("confidence") >= 0.6) & (F.coalesce("level", F.lit(3)) <= 3)


def table_of_contents(blocks: DataFrame) -> DataFrame:
    """(book_id, block_seq, block_id, title, level) of the contents."""
    return blocks.where(in_contents()).select("book_id", "block_seq", "block_id", F.col("content").alias("title"), F.coalesce("level", F.lit(3)).alias("level"))


def statistics(books: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book_id, title, total_blocks, low_confidence_blocks, parser) of every book, without blocks too."""
    found = blocks.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low"), F.min_by("content", "block_seq").alias("first"))
    rows = books.select("book_id", "title").join(found, "book_id", "left")
    return rows.select("book_id", T.or_else("title", F.col("first"), F.lit("")).alias("title"), F.coalesce("n", F.lit(0)).alias("total_blocks"), F.coalesce("low", F.lit(0)).alias("low_confidence_blocks"), F.lit(PARSER_VERSION).alias("parser"))
