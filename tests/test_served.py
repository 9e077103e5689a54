"""Tables bucketed by book: the same answers as from parsed books, without parsing, exchanges or other buckets."""

import re

import pytest

from inkstone import queries as Q
from inkstone.operators import paginate, parse
from inkstone.plans.book import compile_books
from inkstone.plans import served as served_plan
from inkstone.plans.served import Served


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    books = Q.books(spark, "/root/testdata/sf0.001").unionByName(Q.fixture_books(spark))
    made = compile_books(books)
    store = Served(spark, f"file://{tmp_path_factory.mktemp('served')}", buckets=8)
    store.write(made)
    return store, made, books


def plan(df):
    """The plan as it is chosen before any stage has run."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_answers_are_those_of_parsed_books(spark, served):
    store, made, books = served
    asks = spark.createDataFrame([("a", "7", 1, None), ("b", "7", 999, None), ("c", "none", 1, None), ("d", "f1", 1, "x"), ("e", "f2", 0, None), ("f", "f5", 1, None)], "request_id string, book_id string, page_num int, volume string")
    assert rows(store.fetch(asks)) == rows(paginate.fetch_page(made.pages, asks))
    at = asks.selectExpr("request_id", "book_id", "page_num - 1 AS page_index")
    assert rows(store.fetch_at(at)) == rows(paginate.fetch_page_at(made.pages, at))
    assert rows(store.contents()) == rows(paginate.toc_answer(made.toc, made.pages))
    assert rows(store.page("7", 1)) == rows(made.paged.where("book_id = '7' and page_index = 0"))


def test_one_page_reads_one_bucket_and_parses_nothing(spark, served):
    # The plan shows the buckets that are read only where it reads them one by one.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        text = plan(served[0].page("7", 1))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in text and "rlike" not in text.lower()


def test_pages_are_not_exchanged(spark, served):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(served[0].contents())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and not re.search(r"\bExchange\b", text)


def test_another_session_opens_the_tables(spark, served):
    store = served[0]
    for kind in ("pages", "blocks", "toc"):
        spark.sql(f"DROP TABLE {store._name(kind)}")
    assert Served(spark, store.path, buckets=8).contents().count() == served[2].select("book_id").distinct().count()
    assert parse.parse(served[2].where("book_id = 'f1'")).count() == store.table("blocks").where("book_id = 'f1'").count()


def test_pages_are_cut_once(spark, monkeypatch):
    calls, cut = [], paginate.page_starts
    monkeypatch.setattr(paginate, "page_starts", lambda *a, **k: calls.append(a) or cut(*a, **k))
    compile_books(Q.fixture_books(spark))
    assert len(calls) == 1


def test_more_text_is_written_by_more_tasks(spark, served, tmp_path, monkeypatch):
    """Several tasks share a bucket, and what is read is the same."""
    monkeypatch.setattr(served_plan, "SHARE", 20_000, raising=False)
    _, made, _ = served
    store = Served(spark, f"file://{tmp_path}/served", buckets=2)
    store.write(made)
    assert len(list((tmp_path / "served" / "blocks").glob("*.parquet"))) > 2
    assert rows(store.contents()) == rows(paginate.toc_answer(made.toc, made.pages))
    assert rows(store.page("7", 1)) == rows(made.paged.where("book_id = '7' and page_index = 0"))
