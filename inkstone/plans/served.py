"""What a reader is served, kept as tables that are bucketed by book: pages, blocks and contents.

Books are parsed when they are written, not when a page is asked for.  A request for one
book reads one bucket; a table of requests reads pages alone, no blocks; pages and contents
are joined bucket by bucket, without an exchange.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import paginate
from inkstone.operators.parse import SHARE
from inkstone.plans.book import Books
from inkstone.schemas import BLOCK

SCHEMAS = {
    "pages": "book_id string, page_index int, start_block int, end_block int, block_ids array<string>, char_count bigint, volume_block_id string",
    "blocks": f"{BLOCK}, page_index int",
    "toc": "book_id string, block_seq int, block_id string, title string, level int",
}


class Served:
    """Tables in a folder that any session can open; buckets never changes once they are written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _name(self, kind: str) -> str:
        return f"served_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{kind}"

    def write(self, made: Books) -> None:
        """The tables of compiled books, in place of those that are there.

        The more text, the more tasks share a bucket: their number is a multiple of the
        buckets', so each writes one file of one bucket.
        """
        chars = made.blocks.agg(F.sum(F.length("content"))).head()[0] or 0
        tasks = self.buckets * max(1, -(-chars // (SHARE * self.buckets)))
        for kind, rows in (("pages", made.pages), ("blocks", made.paged), ("toc", made.toc)):
            columns = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(kind)}")
            rows.select(columns).repartition(tasks, "book_id").write.mode("overwrite").bucketBy(self.buckets, "book_id").sortBy("book_id").option("path", f"{self.path}/{kind}").saveAsTable(self._name(kind))

    def table(self, kind: str) -> DataFrame:
        if not self.spark.catalog.tableExists(self._name(kind)):
            self.spark.sql(f"CREATE TABLE {self._name(kind)} ({SCHEMAS[kind]}) USING parquet CLUSTERED BY (book_id) SORTED BY (book_id) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'")
        return self.spark.table(self._name(kind))

    def fetch(self, requests: DataFrame) -> DataFrame:
        """Answers to requests (request_id, book_id, page_num, volume), as paginate.fetch_page gives them."""
        return paginate.fetch_page(self.table("pages"), requests)

    def fetch_at(self, requests: DataFrame) -> DataFrame:
        """Answers to 0-based requests (request_id, book_id, page_index)."""
        return paginate.fetch_page_at(self.table("pages"), requests)

    def contents(self) -> DataFrame:
        """(book_id, total_pages, items) of every book; both tables lie in the same buckets."""
        return paginate.toc_answer(self.table("toc"), self.table("pages"))

    def page(self, book_id: str, number: int) -> DataFrame:
        """The blocks of one page, from 1, in order; one bucket is read."""
        rows = self.table("blocks").where((F.col("book_id") == book_id) & (F.col("page_index") == number - 1))
        return rows.orderBy("block_seq")
