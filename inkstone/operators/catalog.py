"""The catalog: entries from files, tags, filters, sorts, pages of results, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.sources.stage import settle

#: Order of the divisions, dynasties that open an author's name, tag patterns.
DIVISIONS = ("洞真部", "洞玄部", "洞神部", "太平部", "太清部", "太玄部", "正一部", "续道藏", "其他")
DYNASTIES = "南北朝宋元明清隋唐五代晉漢秦戰國周商夏"
MAIN = r"^正[統统]道藏(洞[真玄神]部|太平部|太清部|太玄部|正一部)([\x{4e00}-\x{9fff}]+類)?-(.+)\z"
SUPPLEMENT = r"^續[续]道藏-(.+)\z"
SUPPLEMENT_LENIENT = r"^[續续]道藏-(.+)\z"
AUTHOR = rf"^(.+?)-([{DYNASTIES}])[-\x{{4e00}}-\x{{9fff}}]{{1,8}}\z"
TAGS = (
    ("科仪", r"威儀|科儀|齋醮|道場|儀|忏|懺|法事"),
    ("咒诀", r"咒|呪|訣|真言|神呪"),
    ("符箓", r"符|籙|箓|灵符|靈符"),
    ("内丹", r"内丹|內丹|金丹|修真|煉丹|悟真|參同|還丹|丹經|丹訣"),
    ("修炼", r"坐忘|養性|修煉|修眞|清靜|黄庭|黃庭|导引|導引|胎息"),
    ("斋醮", r"齋|醮|祭|祈禳|度亡"),
    ("注释", r"注|疏|解|義|章句|集注|正義"),
    ("文集", r"集|錄|語|論|說|要"),
    ("经典", r"經\z|真經|靈經|妙經"),
    ("续藏", "续"),
)
NOT_CLASSIC = r"注|疏|解"


def parse_name(name: Column, lenient_supplement: bool = False) -> Column:
    """Struct of collection, category, subcategory, title and author read from a file's name."""
    name = F.regexp_replace(name, r"\.txt\z", "")
    supplement = SUPPLEMENT_LENIENT if lenient_supplement else SUPPLEMENT
    main, extra = name.rlike(MAIN), name.rlike(supplement)
    rest = F.when(main, F.regexp_extract(name, MAIN, 3)).when(extra, F.regexp_extract(name, supplement, 1))
    signed = rest.rlike(AUTHOR)
    # The author repeats the dynasty: it stands before the dash and opens what follows.
    author = F.concat(F.regexp_extract(rest, AUTHOR, 2), F.lit("-"), F.substring(rest, F.length(F.regexp_extract(rest, AUTHOR, 1)) + 2, F.length(rest)))
    pick = lambda a, b: F.when(main, a).when(extra, F.lit(b)).otherwise("其他")
    return F.struct(
        F.when(signed, F.regexp_extract(rest, AUTHOR, 1)).otherwise(F.coalesce(rest, name)).alias("title"),
        pick(F.lit("正统道藏"), "续道藏").alias("collection"),
        pick(F.regexp_extract(name, MAIN, 1), "续道藏").alias("category"),
        F.when(main, F.regexp_extract(name, MAIN, 2)).otherwise("").alias("subcategory"),
        F.when(signed, author).alias("author"),
    )


def build(files: DataFrame, lenient_supplement: bool = False) -> DataFrame:
    """Catalog entries from (filename, size, content), sorted by title, ord their position."""
    parsed = files.withColumn("p", parse_name(F.col("filename"), lenient_supplement))
    rows = parsed.select(
        T.stable_id("filename").alias("id"),
        T.or_else("p.title", F.col("filename")).alias("title"),
        T.or_else("p.collection", F.lit("其他")).alias("collection"),
        T.or_else("p.category", F.lit("其他")).alias("category"),
        F.coalesce("p.subcategory", F.lit("")).alias("subcategory"),
        F.col("p.author").alias("author"),
        "filename",
        "size",
        F.size(T.lines("content")).alias("line_count"),
        T.preview("content").alias("preview"),
    )
    return with_position(rows, F.collate("title", "zh"), F.col("id"))


def with_position(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with ord, their 0-based place in a total order, without sorting them in one task.

    Rows are range-partitioned and sorted; a place is the partition's offset, from the small
    table of partition sizes, plus the place inside the partition.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    # Written, so that places stay what they are when an executor is lost.
    spread = settle(rows.withColumns(dict(zip(keys, order))).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()).drop(*keys))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spread.join(F.broadcast(sizes.select("_p", offset.alias("_o"))), "_p")
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("ord", F.col("_o") + inside).drop("_p", "_m", "_o")


def rollup(entries: DataFrame) -> DataFrame:
    """(name, count, subcategories: by sound) by category, in the fixed order, unknown names first."""
    names = F.collect_set(F.when(F.col("subcategory") != "", F.col("subcategory")))
    # By sound; the result is of plain texts again.
    subs = F.transform(F.array_sort(F.transform(F.array_sort(names), lambda x: F.collate(x, "zh"))), lambda x: F.collate(x, "UTF8_BINARY"))
    rows = entries.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("count"), subs.alias("subcategories"))
    return rows.orderBy(F.array_position(F.array(*map(F.lit, DIVISIONS)), F.col("name")), "name")


def summary(entries: DataFrame, version: int = 2, built: str | None = None) -> DataFrame:
    """(version, total_entries, categories), with build_time where one is given."""
    rows = entries.agg(F.lit(version).alias("version"), F.count("*").alias("total_entries"), F.count_distinct("category").alias("categories"))
    return rows if built is None else rows.withColumn("build_time", F.lit(built))


def tags(title: Column, subcategory: Column, collection: Column, category: Column) -> Column:
    """Array of the tags that apply, in the rules' order."""
    out = []
    for tag, pattern in TAGS:
        if tag == "科仪":
            rule = F.concat(title, subcategory).rlike(pattern)
        elif tag == "经典":
            rule = title.rlike(pattern) & ~title.rlike(NOT_CLASSIC)
        elif tag == "续藏":
            rule = collection.contains("续") | (category == "")
        else:
            rule = title.rlike(pattern)
        out.append(F.when(rule, F.lit(tag)))
    return F.filter(F.array(*out), lambda t: t.isNotNull())


def with_tags(entries: DataFrame) -> DataFrame:
    return entries.withColumn("tags", tags(F.col("title"), F.col("subcategory"), F.col("collection"), F.col("category")))


def tag_counts(entries: DataFrame) -> DataFrame:
    return with_tags(entries).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def size_label(line_count: Column) -> Column:
    return F.when(line_count < 200, "短篇").when(line_count < 2000, "中篇").otherwise("长篇")


def by_id(entries: DataFrame, entry_id: str) -> DataFrame:
    return entries.where(F.col("id") == entry_id).orderBy("ord").limit(1)


def in_category(entries: DataFrame, category: str, subcategory: str = "") -> DataFrame:
    rows = entries.where(F.col("category") == category)
    return rows.where(F.col("subcategory") == subcategory) if subcategory else rows


def default_category(entries: DataFrame, category: str | None) -> str | None:
    """The category asked for, even an empty one, else the first of the rollup."""
    if category is not None:
        return category
    first = rollup(entries).head()
    return first["name"] if first else None


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of rows in a total order; number starts at 1."""
    return rows.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def results(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of rows with total, the number of all of them."""
    return page(rows, number, size, *order).withColumn("total", F.lit(rows.count()).cast("long"))


def matches(variants: list[str]) -> Column:
    """Whether title, author or preview holds any variant, case aside."""
    terms = [v.lower() for v in variants]
    parts = [F.coalesce(F.contains(F.lower(c), F.lit(v)), F.lit(False)) for v in terms for c in ("title", "author", "preview")]
    out = F.lit(False)
    for part in parts:
        out = out | part
    return out


def search(entries: DataFrame, variants: list[str]) -> DataFrame:
    """Entries that hold any variant; none for no variant."""
    return entries.where(matches(variants))


def facets(entries: DataFrame, collection: str = "all", short_only: bool = False, chosen: tuple[str, ...] = (), query: str = "") -> DataFrame:
    """The composed filters of the catalog page: collection, length, tags (any), text (all for an empty one)."""
    rows = with_tags(entries)
    if collection == "main":
        rows = rows.where(F.col("collection").contains("正统"))
    elif collection == "supplement":
        rows = rows.where(F.col("collection").contains("续") | (F.col("category") == ""))
    if short_only:
        rows = rows.where("line_count < 200")
    if chosen:
        rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, chosen))))
    query = query.strip()
    return rows.where(matches([query])) if query else rows


def order_of(key: str) -> tuple[Column, ...]:
    """Sort keys by name; ties keep the catalog's order."""
    return {
        "default": (F.col("ord"),),
        "title": (F.collate("title", "zh_Hant"), F.col("ord")),
        "lines-asc": (F.col("line_count"), F.col("ord")),
        "lines-desc": (F.col("line_count").desc(), F.col("ord")),
    }[key]


def adjacent(entries: DataFrame) -> DataFrame:
    """(id, prev_id, next_id) of every entry; ord is dense, so neighbours meet by an equi-join and no window holds all rows."""
    own = entries.select("id", "ord")
    before = entries.select((F.col("ord") + 1).alias("ord"), F.col("id").alias("prev_id"))
    after = entries.select((F.col("ord") - 1).alias("ord"), F.col("id").alias("next_id"))
    return own.join(before, "ord", "left").join(after, "ord", "left").select("id", "prev_id", "next_id")


def related(entries: DataFrame, most: int = 10) -> DataFrame:
    """(id, related_id, rank): the first `most` other entries of each entry's category.

    Only the first most + 1 entries of a category can be related to any, so each side of
    the join is small per key whatever the category's size.
    """
    rank = F.row_number().over(Window.partitionBy("category").orderBy("ord"))
    heads = entries.select("category", "ord", F.col("id").alias("related_id"), rank.alias("place")).where(F.col("place") <= most + 1)
    lists = heads.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("place", "related_id"))).alias("heads"))
    rows = entries.select("id", "category").join(lists, "category")
    others = F.slice(F.filter("heads", lambda h: h["related_id"] != F.col("id")), 1, most)
    return rows.select("id", F.posexplode(others).alias("pos", "h")).select("id", F.col("h.related_id").alias("related_id"), (F.col("pos") + 1).alias("rank"))


def picks(entries: DataFrame, titles: list[str]) -> DataFrame:
    """(title, id): for each wanted title the first entry whose title holds it; misses are left out."""
    wanted = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(t).alias("wanted")) for i, t in enumerate(titles)))
    rows = entries.select("id", "ord", "title", F.explode(wanted).alias("w")).where(F.contains("title", F.col("w.wanted")))
    found = rows.groupBy("w").agg(F.min_by("id", "ord").alias("id"))
    return found.select(F.col("w.place").alias("place"), F.col("w.wanted").alias("title"), "id")


def daily_pick(entries: DataFrame, now_ms: int) -> DataFrame:
    """The entry of the day."""
    total = entries.count()
    return entries.where(F.col("ord") == (now_ms // 86_400_000) % total) if total else entries.limit(0)
