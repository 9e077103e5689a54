"""Variants, concepts, references, notes, tools, sources and streams."""

import json
import pathlib
import random
import subprocess
import sys

import pytest

from inkstone import queries as Q
from inkstone.functions.variants import query_variants, rules, traditional, variants_of
from inkstone.operators import behaviour, catalog, footnotes, report, retrieve, search, tools
from inkstone.plans.book import compile_books
from inkstone.sources import tables
from inkstone.streaming import events
from pyspark.sql import functions as F


def test_variants(spark):
    assert query_variants(spark, "道德经")[:2] == ["道德经", "道德經"]
    found = query_variants(spark, "无为")
    assert len(found) >= 2 and any("爲" in v or "為" in v for v in found)
    assert query_variants(spark, "道德經")[0] == "道德經" and len(set(query_variants(spark, "道德經"))) == len(query_variants(spark, "道德經"))
    assert query_variants(spark, "  ") == []


@pytest.mark.parametrize(
    "question, has, lacks",
    [("什么是清静无为？", ["清静无为"], []), ("《道德經》的核心思想是什么？", ["核心思想"], ["道德經"]), ("内丹与外丹有什么区别？", ["内丹", "外丹"], [])],
)
def test_concepts(spark, question, has, lacks):
    found = spark.createDataFrame([(question,)], "q string").select(retrieve.concepts(F.col("q"))).head()[0]
    assert set(has) <= set(found) and not set(lacks) & set(found)


def test_three_concepts_at_most(spark):
    assert len(spark.createDataFrame([("内丹 外丹 符箓 斋醮 存思 坐忘",)], "q string").select(retrieve.concepts(F.col("q"))).head()[0]) == 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (0, "a", "道德經", "正统道藏", "太玄部", "", None, 3, "道可道，非常道。", "道可道，非常道。清靜無爲。"),
        (1, "b", "清靜經", "正统道藏", "洞神部", "", None, 3, "大道無形", "大道無形，清靜無為，清靜無為。"),
        (2, "c", "悟真篇", "正统道藏", "洞真部", "", None, 3, "內丹之書", "內丹與外丹。道德經云云。"),
    ]
    return spark.createDataFrame(rows, "ord long, id string, title string, collection string, category string, subcategory string, author string, line_count int, preview string, content string")


def test_references(spark, docs):
    found = retrieve.references(spark, docs, "《道德經》和清静无为、内丹有什么关系？", {"book_id": "z", "book_title": "Z"})
    assert [(r["book_id"], r["source"]) for r in found] == [("a", "title"), ("b", "清静无为"), ("c", "内丹"), ("z", "reading")]


def test_blank_query_finds_nothing(spark, docs):
    assert search.search(docs, query_variants(spark, " ")).count() == 0
    assert catalog.search(docs, query_variants(spark, " ")).count() == 0


def test_inline_notes(spark):
    q = lambda s: spark.createDataFrame([(s,)], "c string")
    kinds = q("請按東井讖#133，清潔吉日#134沐浴").select(footnotes.segments(F.col("c"))).head()[0]
    assert [(k.kind, k.num) for k in kinds] == [("text", None), ("ref", 133), ("text", None), ("ref", 134), ("text", None)]
    assert [k.value for k in q("a#b#12c＃3#").select(footnotes.segments(F.col("c"))).head()[0]] == ["a#b", "#12", "c", "＃3", "#"]
    d = q("＃1 環珮鏘鏘：敦煌本作「玉質蠶蠻」。").select(footnotes.definition(F.col("c"))).head()[0]
    assert (d.nums, d.body) == ([1], "環珮鏘鏘：敦煌本作「玉質蠶蠻」。")
    assert q("周易參同契序#1").select(footnotes.is_definition(F.col("c"))).head()[0] is False


def test_tools(docs):
    registry = tools.Registry()
    registry.add(tools.Tool("entry", lambda entry_id: catalog.by_id(docs, entry_id), ("entry_id",)))
    assert registry.call("entry", {"entry_id": "b"}).head().title == "清靜經"
    for name, args in (("nope", {}), ("entry", {})):
        with pytest.raises(tools.ToolError):
            registry.call(name, args)


def test_standard_tools(spark, docs):
    made = tools.standard(spark, docs, compile_books(Q.fixture_books(spark)))
    assert [r.id for r in made.call("search_text", {"query": "清静无为"}).collect()] == ["b", "a"]
    assert [r.id for r in made.call("search_catalog", {"query": "悟真"}).collect()] == ["c"]
    toc, blocks = made.call("get_chapter", {"book_id": "f2"})
    assert (toc.count(), blocks.count()) == (2, 10) and made.call("related_books", {"entry_id": "a"}).count() == 0


def test_catalog_from_files(spark, tmp_path):
    (tmp_path / "正統道藏洞真部本文類-甲經-宋某人.txt").write_text("甲\r\n乙\n", encoding="utf-8")
    (tmp_path / "雜記.txt").write_text("x", encoding="utf-8")
    (tmp_path / "skip.md").write_text("x", encoding="utf-8")
    rows = {r.title: r for r in catalog.build(tables.scan_texts(spark, str(tmp_path))).collect()}
    assert rows["甲經"].author == "宋-宋某人" and rows["甲經"].line_count == 3 and rows["甲經"].subcategory == "本文類"
    assert rows["雜記"].category == "其他" and sorted(r.ord for r in rows.values()) == [0, 1]


def test_side_files(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"b": {"1:x": {"type": "verse", "level": 2, "reviewedAt": 5}}}))
    assert [tuple(r) for r in tables.read_side_file(spark, str(path), "overrides").collect()] == [("b", "1:x", "verse", 2, 5)]
    assert tables.read_side_file(spark, str(tmp_path / "none.json"), "illustrations").count() == 0
    path.write_text("broken")
    assert tables.read_side_file(spark, str(path), "overrides").count() == 0


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"version": 2, "entries": [{"id": "a", "title": "T", "lineCount": 3, "size": 9}, {"id": "b", "title": "U"}]}))
    rows = tables.read_catalog(spark, str(path)).orderBy("ord").collect()
    assert [(r.id, r.line_count, r.ord) for r in rows] == [("a", 3, 0), ("b", None, 1)]


def test_compiled_books_and_report(spark, docs):
    made = compile_books(Q.fixture_books(spark))
    assert made.pages.where("book_id = 'f5'").head().char_count == 0
    chars = made.blocks.selectExpr("sum(length(content)) n").head().n
    assert made.pages.selectExpr("sum(char_count) n").head().n == chars
    assert report.markdown(made.blocks_raw, docs, "2026-01-01").startswith("# Parsing quality")


def test_quota_key_hash(spark):
    def js(s):
        h = 0
        for c in s:
            h = (31 * h + ord(c) + 2**31) % 2**32 - 2**31
        return h

    rows = spark.createDataFrame([("203.0.113.9",), ("長路徑abc",)], "s string")
    from inkstone.functions.text import poly31

    assert [r[1] for r in rows.select("s", poly31("s")).collect()] == [js("203.0.113.9"), js("長路徑abc")]


def test_registration_and_jobs(spark):
    users = spark.createDataFrame([("1", "A@x.org", "n", 1)], "id string, email string, name string, created_at long")
    rows = spark.createDataFrame([("a@X.org", 8), ("b@x.org", 8), ("bad", 8), ("c@x.org", 3), (None, None)], "email string, password_length int")
    assert [r.status for r in behaviour.valid_registration(rows, users).collect()].count(200) == 1
    jobs = spark.createDataFrame([("j1", "b", "k", "scene", "done", "/u"), ("j2", "b", "l", "scene", "failed", None), ("j3", "b", "m", "scene", "pending", None)], "id string, book_id string, block_id string, type string, status string, image_url string")
    asks = spark.createDataFrame([("b", x, None) for x in "klmn"], "book_id string, block_id string, type string")
    assert {r.block_id: r.action for r in behaviour.job_requests(asks, jobs).collect()} == {"k": "reuse", "l": "reject", "m": "reuse", "n": "insert"}


def test_stream_ingest(spark, tmp_path):
    bodies = spark.createDataFrame([(i, b, "u", "agent", 1_700_000_000_000) for i, b in Q.BODIES[:6]], "batch_id string, body string, user_id string, user_agent string, created_at long")
    bodies.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(bodies.schema).json(str(tmp_path / "in"))
    events.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.event for r in behaviour.stored_events(spark, str(tmp_path / "out")).collect()) == ["page_view", "search", "share"]
    query = events.windowed_counts(spark.readStream.schema(behaviour.stored_events(spark, str(tmp_path / "out")).schema).parquet(str(tmp_path / "out")))
    running = query.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert spark.sql("select sum(n) from counts").head()[0] == 3


def test_footnotes_of_documents(spark, tmp_path):
    from inkstone import queries

    rows = [(1, "Title\nSee here#3 and there#4.\n#3 A note：what it says.\n", "en", "s", 50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    own = lambda q: q(spark, str(tmp_path)).where("book_id = '1'").collect()
    assert sorted(r.num for r in own(queries.footnote_refs)) == [3, 4]
    assert [r.num for r in own(queries.footnote_definitions)] == [3]
    assert [r.num for r in own(queries.footnote_orphans)] == [4]
    assert [(r.resolved, r.orphans) for r in own(queries.footnote_counts)] == [(1, 1)]
    assert len(own(queries.footnote_resolve)) == 2


def test_variants_of_a_column(spark):
    asked = ["里面", "面条", "制造", "头发", "皇后", "理发师", "一周", "周一", "百余", "三只", "丰姿", "丰 收", "海里", "干干净净","道德经", "无为", "道德經", "  ", "", "灵宝领教济度金书", "里 裏 裡", "abc", None, "　真人﻿"]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string")
    found = {r.i: r.v for r in rows.select("i", variants_of(spark, F.col("q")).alias("v")).collect()}
    assert [found[i] for i in range(len(asked))] == [query_variants(spark, q or "") for q in asked]
    assert found[0] == ["里面", "裏面", "裡面"] and found[5] == ["理发师", "理髮師"]


def test_conversion_is_that_of_the_library(spark):
    """Every phrase, every character, and phrases side by side."""
    found = rules(spark)
    phrases = [r[1] for own in found.values() for r in own]
    rng = random.Random(1)
    mixed = ["".join(rng.choice(phrases + list("一三千周里余，a")) for _ in range(6)) for _ in range(3000)]
    texts = [*phrases, *mixed, "".join(chr(c) + "，" for c in range(0x3400, 0xA000))]
    library = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Hans-Hant").transliterate("\n".join(texts)).split("\n")
    assert [traditional(found, t) for t in texts] == library


def test_references_find_what_a_search_finds(spark):
    """A term with several traditional forms is met in each of them."""
    schema = "id string, ord long, title string, author string, preview string, content string"
    texts = ["裡面", "裏面", "里面", "麪條", "麵條", "理髮師", "皇后", "製造", "x"]
    docs = spark.createDataFrame([(str(i), i, "t", None, "p", f"前{t}後") for i, t in enumerate(texts)], schema)
    terms = ["里面", "面条", "理发师", "皇后", "制造"]
    asked = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(terms)], "question_id long, q string, book_id string, book_title string, block_id string")
    cited = {(r.question_id, r.book_id) for r in retrieve.references_of(docs, asked).collect()}
    assert cited == {(i, r.id) for i, t in enumerate(terms) for r in search.find(docs, t, 1, 2).collect()}


def test_many_questions(spark, docs):
    asked = [(1, "《道德經》和清静无为、内丹有什么关系？", "z", "Z", None), (2, "内丹", "c", "C", "b1"), (3, "", None, None, None)]
    rows = spark.createDataFrame(asked, "question_id long, q string, book_id string, book_title string, block_id string")
    found = sorted((r.question_id, r.place, r.book_id, r.source) for r in retrieve.references_of(docs, rows).collect())
    assert found == [(1, 1, "a", "title"), (1, 2, "b", "清静无为"), (1, 3, "c", "内丹"), (1, 4, "z", "reading"), (2, 1, "c", "内丹")]
    plan = retrieve.references_of(docs, rows)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("few", [0, 2000])
def test_terms_meet_texts_by_their_rarest_gram(spark, monkeypatch, few):
    monkeypatch.setattr(retrieve, "FEW", few)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abc天 ") for _ in range(rng.randrange(n)))
    texts = [(str(i), rng.choice([None, "", text(30), text(30)])) for i in range(80)]
    terms = [(t, v) for t in {text(5) for _ in range(60)} for v in {t, text(4)}] + [("n", None)]
    pairs = retrieve.holding(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(terms, "term string, variant string"))
    found = {tuple(r) for r in pairs.collect()}
    must = {(t, i) for t, v in terms if v for i, x in texts if x and v in x}
    assert must <= found
    few = retrieve.holding(spark.createDataFrame([("1", "abab"), ("2", "abxy")], "id string, text string"), spark.createDataFrame([("t", "abxy")], "term string, variant string"))
    assert [r.id for r in few.collect()] == ["2"]


def test_entry_without_an_optional_library():
    """A library that one optional operator needs is missing: the core queries are there."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; from inkstone import queries; assert set(e.queries()) == set(queries.queries()) and set(e.oracle_sql()) == set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parent.parent, capture_output=True).returncode == 0


def test_sources_refuse_no_kind_of_body(spark):
    """Bodies that are no list of events give no rows, whatever they are."""
    bodies = [None, "", " ", "[", "null", "7", '"x"', '{"events":7}', '{"events":null}', "[[]]", '[{"event":7}]', '{"event":"share","event":"search"}']
    rows = spark.createDataFrame([(str(i), b, None, None, 1) for i, b in enumerate(bodies)], "batch_id string, body string, user_id string, user_agent string, created_at long")
    assert behaviour.expand_batches(rows).collect() == []
    assert {r.status for r in behaviour.batch_status(rows).collect()} == {400}


def test_default_category(docs):
    """What is asked for counts, even an empty name; else the first of the fixed order."""
    assert [catalog.default_category(docs, c) for c in ("", "x", None)] == ["", "x", "洞真部"]
    assert catalog.default_category(docs.limit(0), None) is None
