"""Sources and sinks: text files, catalog and side files, documents, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone import schemas
from inkstone.operators import catalog
from inkstone.sources.stage import write_text


def scan_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, size, content) of a folder's .txt files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("filename"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a catalog file, with their position as ord."""
    fields = "id string, title string, collection string, category string, subcategory string, author string, filename string, size long, lineCount int, preview string"
    whole = spark.read.schema(f"version int, buildTime string, totalEntries long, entries array<struct<{fields.replace(' string', ': string').replace(' long', ': long').replace(' int', ': int')}>>").json(path, multiLine=True)
    rows = whole.select(F.posexplode("entries").alias("ord", "e"))
    return rows.select("e.*", F.col("ord").cast("long").alias("ord")).withColumnRenamed("lineCount", "line_count")


def read_side_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Overrides or illustrations, one row each; a missing or broken file gives no rows."""
    inner, schema = {
        "overrides": ("struct<type: string, level: int, reviewedAt: bigint>", schemas.OVERRIDE),
        "illustrations": ("struct<image: string, caption: string, position: string, aiGenerated: boolean>", schemas.ILLUSTRATION),
    }[kind]
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, map<string, {inner}>>").alias("m"))
    rows = parsed.select(F.explode("m").alias("book_id", "own")).select("book_id", F.explode("own").alias("key", "v"))
    if kind == "overrides":
        return rows.select("book_id", "key", "v.type", "v.level", F.col("v.reviewedAt").alias("reviewed_at"))
    return rows.select("book_id", "key", "v.image", "v.caption", "v.position", F.col("v.aiGenerated").alias("ai_generated"))


def content_of(ids: DataFrame, contents: DataFrame) -> DataFrame:
    """ids with their content, an empty one where there is none."""
    return ids.join(contents.select("id", "content"), "id", "left").withColumn("content", F.coalesce("content", F.lit("")))


def corpus(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """Entries with content; entries without are left out."""
    return entries.join(contents.select("id", "content"), "id")


def write_documents(contents: DataFrame, path: str, buckets: int = 64) -> None:
    """(id, content) as one Parquet table, dealt by a hash of the id, so that one id is looked up in one folder."""
    contents.select("id", "content", _bucket(F.col("id"), buckets).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_document(spark: SparkSession, path: str, entry_id: str, buckets: int = 64) -> DataFrame:
    """The (id, content) of one id; the other buckets are not read."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("bucket") == _bucket(F.lit(entry_id), buckets)) & (F.col("id") == entry_id)).select("id", "content")


def _bucket(entry_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(entry_id), F.lit(buckets)).cast("int")


def write_catalog(entries: DataFrame, path: str, built: str, version: int = 2) -> None:
    """The catalog: path/entries as JSON lines with their position, path/categories, and path/index, one row with version, build time and total."""
    entries.write.mode("overwrite").json(f"{path}/entries")
    catalog.rollup(entries).coalesce(1).write.mode("overwrite").json(f"{path}/categories")
    catalog.summary(entries, version, built).coalesce(1).write.mode("overwrite").json(f"{path}/index")


def write_overrides(overrides: DataFrame, path: str) -> None:
    """Overrides as the JSON map that read_side_file reads, written whole; books without any are left out.

    It is a file of human decisions, small enough for one row.
    """
    one = F.struct("type", "level", F.col("reviewed_at").alias("reviewedAt"))
    books = overrides.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("key"), one.alias("value"))))).alias("own"))
    found = books.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("book_id", "own")))).alias("text")).head()
    write_text(overrides.sparkSession, path, found["text"] or "{}")


def sitemap(entries: DataFrame, base: str) -> DataFrame:
    """(url, change_frequency, priority): four fixed pages, then one for each entry."""
    rows = [("", "monthly", 1.0), ("/catalog", "monthly", 0.9), ("/search", "monthly", 0.8), ("/about", "yearly", 0.5)]
    fixed = entries.sparkSession.createDataFrame([(base + p, f, x) for p, f, x in rows], "url string, change_frequency string, priority double")
    return fixed.unionByName(entries.select(F.concat(F.lit(f"{base}/text/"), "id").alias("url"), F.lit("yearly").alias("change_frequency"), F.lit(0.6).alias("priority")))
