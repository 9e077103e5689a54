"""Queries over the driver's tables, one for each operator or family, and their DuckDB SQL.

documents stand for catalog entries and books, pages for raw files, events for behavioural
data, conversations for chats; rules for Chinese text run over the fixtures below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import behaviour, catalog, enrich, footnotes, paginate, parse, report, retrieve, search, spans, tools
from inkstone.plans.book import compile_books
from inkstone.plans.served import Served
from inkstone.sources import tables
from inkstone.sources.grams import GramIndex
from inkstone.sources.stage import fresh_path, settle, write_text
from inkstone.sources.store import Store
from inkstone.streaming import events as stream

BASE = "https://example.org"

#: (book_id, title, lines): what each rule of the parser is for.
BOOKS = [
    ("f1", "三洞珠囊", ["三洞珠囊", "", "經名：三洞珠囊。唐王懸河編。十卷。底本出處：《正統道藏》太平部。", "", "三洞珠囊卷之一", "", "救導品", "　　《道學傳第四》云：任敦，字尚能，博昌人。永嘉中投雲陽山。", "　　又云：杜炅，字子恭，及壯識信精勤，宗事正一。"]),
    ("f2", "靈寶領教濟度金書", ["靈寶領教濟度金書", "", "卷之一", "呪曰", "　　天地玄宗，萬炁本根。", "頌曰：", "　　身有金光，覆映吾身。", "又", "　　再誦三遍。", "武林道士褚伯秀學", "靈寶領教濟度金書卷之一竟"]),
    ("f3", "無上黃籙大齋立成儀", ["無上黃籙大齋立成儀", "", "目錄", "宣衛靈咒", "　　琳琅振響，十方肅清。", "其二", "　　天地玄宗，萬炁本根。", "各禮師存念如法", "　　次請稱職奏請。"]),
    ("f4", "某某經", ["某某經", "", "短句甲", "　　正文段落內容，這裏是一段經文。"]),
    ("f5", "", [""]),
    ("f6", "題", ["題", "三洞珠囊卷之一", "天地玄宗", "萬炁本根", "", "天地玄宗", "", "甲乙丙丁", "三洞珠囊卷之一", "戊己庚辛", "　縮排正文。"]),
    ("f7", "三洞珠囊", ["﻿三洞珠囊\r", "三洞珠囊卷上\r", "請按東井讖#133，清潔吉日#134沐浴，見＃7。\r", "#133東井識：敦煌本作『東井記』。\r", "#6#23于：教煌本作『乎』。\r", "　　再見#6與#23。\r", "三洞珠囊卷下\r", "此處#6無注，#1有注。\r", "＃1 環珮鏘鏘：敦煌本作「玉質蠶蠻」。\r", "#1後注從此。"]),
    ("f8", "匣中雜記", ["匣中雜記", "　　匣裡面有麵條，製造於后土廟前。", "　　其裏面無它。"]),
]
FILES = ["正統道藏洞真部本文類-元始無量度人上品妙經-宋陳椿榮", "正统道藏太平部-三洞珠囊", "續续道藏-太上中道妙法蓮華經", "續道藏-弘道錄-明邵經邦", "续道藏-老子翼-明焦竑", "正統道藏太清部-黃帝陰符經集解-金刘处玄", "雜記", "正統道藏洞玄部威儀類-太上黃籙齋儀-前蜀杜光庭"]
QUESTIONS = ["什么是清静无为？", "《道德經》的核心思想是什么？", "内丹与外丹有什么区别？", "内丹 外丹 符箓 斋醮 存思 坐忘", "请问如何理解坐忘论和存思", "", "hello"]
BODIES = [
    ("b1", '[{"event":"page_view","sessionId":"s1","bookId":"x","extra":{"ts":5}},{"event":"nope"},{"event":"search","sessionId":7}]'),
    ("b2", '{"events":[{"event":"share","sessionId":"s2"}]}'),
    ("b3", "[]"),
    ("b4", "[" + ",".join('{"event":"share"}' for _ in range(51)) + "]"),
    ("b5", '[{"event":"unknown"},3]'),
    ("b6", "not json"),
    # The session's type is that of the member itself, not of a like-named one inside extra; white space may come first; a text is no event.
    ("b7", '[{"event":"share","sessionId":7,"extra":{"sessionId":"abc"}},{"event":"search","bookId":null,"extra":{"b":1,"a":[2]}}]'),
    ("b8", '\r\n\t [ {"event" : "page_view" , "sessionId" : "s8"} , "{\\"event\\":\\"share\\"}" , null , [] ] '),
    ("b9", '{"events":{"event":"share"}}'),
    ("b10", '{"event":"share"}'),
    ("b11", '{"events":[{"event":"music_play","sessionId":"\u4e00","extra":0},{"event":["share"]}]}'),
    ("b12", "[" + ",".join('{"event":"share","bookId":"x%d"}' % i for i in range(50)) + "]"),
    ("b13", None),
    # Texts and numbers are told apart, numbers stand in their shortest form, of repeated members the last counts, nothing may follow the value.
    ("b14", '[{"event":"share","extra":"abc"},{"event":"share","extra":"0"},{"event":"share","extra":0.0},{"event":"share","extra":""},{"event":"share","extra":{"a":1.0,"b":[1e3,"1.0"],"ts":2.0}},{"event":"share","extra":true},{"event":"share","extra":[]}]'),
    ("b15", '[{"event":"share"}] trailing'),
    ("b16", '[{"event":"nope","event":"share","sessionId":1,"sessionId":"s","extra":{"z":1,"a":2,"z":3}}]'),
    ("b17", '{"events":[],"events":[{"event":"search","extra":1.50}]}'),
]
#: (question_id, q, book_id, book_title, block_id).
ASKED = [(0, "《三洞珠囊》的天地玄宗是什么？", "f2", "x", "b1"), (1, "什么是天地玄宗？", None, None, None), (2, "《Tion》和《三洞》与天地玄宗、金光、投雲陽山", "f9", None, None), (3, "hello", "f1", "y", None), (4, "《囊》", "", None, None), (5, "正文，天地玄宗，金光", None, None, None), (6, "里面和面条是什么？", "f8", "x", None), (7, "《灵宝领教》与制造、后土", None, None, None), (8, "《匣中杂记》", None, None, None)]
TOOL_CALLS = [("entry", "f1", ""), ("entry", "", ""), ("nope", "f1", ""), ("hidden", "f1", ""), ("hidden", "f1", "review"), ("entry", "zz", "")]
NOW_MS = 1_780_000_000_000


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as catalog entries with content."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("category"),
        F.col("source").alias("subcategory"),
        F.when(F.col("lang") == "en", "正统道藏").otherwise("续道藏").alias("collection"),
        F.when(F.col("lang") != "en", F.col("source")).alias("author"),
        F.size(T.lines("text")).alias("line_count"),
        T.preview("text").alias("preview"),
        F.col("text").alias("content"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("book_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("source"))


def fixture_books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, t, "\n".join(x)) for b, t, x in BOOKS], "book_id string, title string, source string")


def _blocks(spark, sf_dir):
    return parse.parse(books(spark, sf_dir))


def _all_books(spark, sf_dir):
    return books(spark, sf_dir).unionByName(fixture_books(spark))


def _all_blocks(spark, sf_dir):
    return parse.parse(_all_books(spark, sf_dir))


def _written_blocks(spark, sf_dir):
    """The blocks for queries that need them more than once: parsed once, written, read from there."""
    return settle(_all_blocks(spark, sf_dir))


def _fixture_entries(spark):
    own = fixture_books(spark)
    place = F.substring("book_id", 2, 9).cast("long") + 1_000_000_000
    return own.select(place.alias("ord"), F.col("book_id").alias("id"), "title", F.lit("太清部").alias("category"), F.lit("").alias("subcategory"), F.lit("正统道藏").alias("collection"), F.lit(None).cast("string").alias("author"), F.size(T.lines("source")).alias("line_count"), T.preview("source").alias("preview"), F.col("source").alias("content"))


def corpus(spark, sf_dir):
    """The entries, and after them the fixture books."""
    return entries(spark, sf_dir).unionByName(_fixture_entries(spark))


def _events(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    name = F.when(F.col("event_type") == "click", "recommendation_click").when(F.col("event_type") == "view", "page_view").when(F.col("event_type") == "signup", "book_open").otherwise(F.col("event_type"))
    return ev.select("event_id", name.alias("event"), F.col("user_id").cast("string").alias("user_id"), "event_type", "value", F.col("props").alias("extra_json"), at.alias("created_at"), F.col("ts").cast("timestamp").alias("ts"))


def _overrides(blocks):
    """A correction for the second block of every third book."""
    rows = blocks.where((F.col("block_seq") == 1) & (F.pmod(F.crc32(F.col("book_id").cast("binary")), F.lit(3)) == 0))
    kind = F.when(F.length("content") % 2 == 0, "paragraph").otherwise("subheading")
    return rows.select("book_id", enrich.block_key().alias("key"), kind.alias("type"), F.when(F.length("content") % 2 == 1, 3).cast("int").alias("level"), F.lit(1).cast("long").alias("reviewed_at"))


def _illustrations(blocks):
    rows = blocks.where((F.col("block_seq") == 2) & (F.length("content") % 2 == 0))
    return rows.select("book_id", enrich.block_key().alias("key"), F.lit("a.png").alias("image"), F.substring("content", 1, 5).alias("caption"), F.when(F.length("content") % 4 == 0, "after").otherwise("before").alias("position"))


# --- catalog


def catalog_rollup(spark, sf_dir):
    return catalog.rollup(entries(spark, sf_dir)).select("name", "count", F.array_join("subcategories", ",").alias("subcategories"))


#: Subcategories in no order; by sound they begin ben, biao, fang, jie, jì, ling, pu, shen, wei, yu, zan, zhong.
SUBCATEGORIES = ("眾術類", "威儀類", "本文類", "譜錄類", "玉訣類", "", "神符類", "方法類", "讚頌類", "戒律類", "表奏類", "靈圖類")


def rollup_by_sound(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, SUBCATEGORIES)), F.pmod("ord", F.lit(len(SUBCATEGORIES))).cast("int"))
    return catalog.rollup(entries(spark, sf_dir).withColumn("subcategory", kind)).select("name", "count", F.array_join("subcategories", ",").alias("subcategories"))


def catalog_of_pages(spark, sf_dir):
    """The catalog of raw pages, as files named by every rule."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = F.get(F.array(*map(F.lit, FILES)), F.pmod("page_id", F.lit(len(FILES))).cast("int"))
    head = F.substring_index(name, "-", 1)
    number = F.col("page_id").cast("string")
    named = F.concat(F.when(F.contains(name, F.lit("-")), F.concat(head, F.lit("-"), number, F.substring(name, F.length(head) + 2, F.length(name)))).otherwise(F.concat(name, number)), F.lit(".txt"))
    files = pages.select(named.alias("filename"), F.octet_length("html").cast("long").alias("size"), F.col("html").alias("content"))
    return catalog.build(files).drop("ord", "preview")


def jobs_of_orders(spark, sf_dir):
    """Requests for illustrations against the jobs that orders stand for: some are there, in every state, some are not."""
    n = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    state = F.when(n % 4 == 0, "done").when(n % 4 == 1, "pending").when(n % 4 == 2, "processing").otherwise("failed")
    jobs = orders.where(n % 7 > 0).select(n.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("book_id"), F.concat(F.lit("k"), n.cast("string")).alias("block_id"), F.when(n % 5 == 0, "map").otherwise("scene").alias("type"), state.alias("status"), F.when(n % 3 > 0, F.lit("/i")).when(n % 3 == 0, F.lit("")).alias("image_url"))
    asks = orders.select(F.col("o_custkey").cast("string").alias("book_id"), F.concat(F.lit("k"), n.cast("string")).alias("block_id"), F.when(n % 2 == 0, "scene").alias("type"))
    return behaviour.job_requests(asks, jobs).select("block_id", "job_id", "action")


def catalog_summary(spark, sf_dir):
    return catalog.summary(entries(spark, sf_dir))


def catalog_filter_page(spark, sf_dir):
    return catalog.page(catalog.in_category(entries(spark, sf_dir), "en", "src1"), 1, 30, F.col("ord")).select("id", "title")


def catalog_metadata_search(spark, sf_dir):
    return catalog.search(entries(spark, sf_dir), ["Erst", "src1"]).select("id", "title", "author")


def catalog_facets(spark, sf_dir):
    rows = catalog.facets(entries(spark, sf_dir), "supplement", True, ("续藏", "科仪"), "en")
    return catalog.page(rows, 2, 24, *catalog.order_of("lines-desc")).select("id", "line_count", F.array_join("tags", ",").alias("tags"))


def tag_counts(spark, sf_dir):
    return catalog.tag_counts(entries(spark, sf_dir))


def tag_rules(spark, sf_dir):
    rows = spark.createDataFrame([(f,) for f in FILES], "filename string").select("filename", catalog.parse_name(F.col("filename")).alias("p")).select("filename", "p.*")
    return catalog.with_tags(rows).select("filename", F.array_join("tags", ",").alias("tags"))


def parse_names(spark, sf_dir):
    rows = spark.createDataFrame([(f,) for f in FILES], "filename string")
    strict = rows.select("filename", catalog.parse_name(F.col("filename")).alias("p")).select("filename", "p.*")
    lenient = rows.select("filename", catalog.parse_name(F.col("filename"), True)["category"].alias("lenient_category"))
    return strict.join(lenient, "filename")


def size_labels(spark, sf_dir):
    rows = entries(spark, sf_dir).select(catalog.size_label(F.col("line_count") * 20).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def entry_profile(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", T.stable_id("url").alias("id"), F.octet_length("html").alias("size"), F.size(T.lines("html")).alias("line_count"), T.preview("html").alias("preview"))


def adjacent_entries(spark, sf_dir):
    return catalog.adjacent(entries(spark, sf_dir))


def related_entries(spark, sf_dir):
    return catalog.related(entries(spark, sf_dir))


def title_picks(spark, sf_dir):
    return catalog.picks(entries(spark, sf_dir), ["Erst", "Tion", "zzzz", "les", "der "])


def daily_pick(spark, sf_dir):
    return catalog.daily_pick(entries(spark, sf_dir), NOW_MS).select("id", "title")


def sitemap(spark, sf_dir):
    return tables.sitemap(entries(spark, sf_dir), BASE)


# --- search


def fulltext_search(spark, sf_dir):
    return search.search(entries(spark, sf_dir), ["eron", "thth"], 1, 20).select("id", "title", "matched_term", "match_count", "snippet", "title_hit")


def fulltext_hits(spark, sf_dir):
    return search.hits(entries(spark, sf_dir), ["ción", "ung"]).select("id", "matched_term", "pos", "match_count", "snippet", "title_hit")


def fulltext_after(spark, sf_dir):
    """The third page, reached by the cursors of the pages before it, and the total that its pass observes."""
    own, last, seen = entries(spark, sf_dir), None, None
    for _ in range(3):
        found, seen = search.after(own, ["ción", "ung"], last, 5)
        page = settle(found)
        end = page.orderBy(*search.ranked(page)).collect()[-1:]
        last = (end[0].title_hit, end[0].match_count, end[0].ord) if end else last
    return page.select("id", "match_count", "snippet", F.lit(seen.get["total"]).cast("long").alias("total"))


def fulltext_total(spark, sf_dir):
    return search.total(entries(spark, sf_dir), ["ción", "ung"])


def _indexed(spark, sf_dir):
    """The corpus as an index of two segments, the fixture books added behind the entries."""
    index = GramIndex(spark, fresh_path(spark, "grams"))
    index.add(entries(spark, sf_dir), "entries")
    index.add(_fixture_entries(spark), "fixtures")
    return index


def indexed_hits(spark, sf_dir):
    return _indexed(spark, sf_dir).hits(["ción", "ung", "天地玄宗"]).select("id", "matched_term", "pos", "match_count", "snippet", "title_hit")


def indexed_short(spark, sf_dir):
    """Terms of one and two characters, which are shorter than a gram."""
    return _indexed(spark, sf_dir).hits(["囊", "ß", "qu"]).select("id", "matched_term", "pos", "match_count", "snippet", "title_hit")


def indexed_page(spark, sf_dir):
    return _indexed(spark, sf_dir).search(["eron", "thth"], 1, 20).select("id", "title", "matched_term", "match_count", "snippet", "title_hit")


def indexed_metadata(spark, sf_dir):
    return _indexed(spark, sf_dir).metadata(["Erst", "src1", "三洞"]).select("id", "title", "author")


def in_book_search(spark, sf_dir):
    return search.in_book(_blocks(spark, sf_dir), "7", "on").select("block_id", "snippet")


def highlight_pieces(spark, sf_dir):
    rows = entries(spark, sf_dir).select("id", search.highlight(F.col("title"), "on").alias("p"))
    return rows.select("id", F.size("p").alias("pieces"), F.array_join("p", "[on]").alias("marked"))


def visible_text(spark, sf_dir):
    return search.visible_text(_blocks(spark, sf_dir))


def whole_text(spark, sf_dir):
    return search.whole_text(_blocks(spark, sf_dir)).select("book_id", F.md5("text").alias("md5"), F.length("text").alias("chars"))


def concept_terms(spark, sf_dir):
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "id int, q string")
    return rows.select("id", F.array_join(retrieve.titles(F.col("q")), ",").alias("titles"), F.array_join(retrieve.concepts(F.col("q")), ",").alias("concepts"))


# --- parsing


def parse_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)


def parse_fixtures(spark, sf_dir):
    return parse.parse(fixture_books(spark))


def parse_toc(spark, sf_dir):
    return parse.table_of_contents(_all_blocks(spark, sf_dir))


def parse_stats(spark, sf_dir):
    every = _all_books(spark, sf_dir)
    return parse.statistics(every, parse.parse(every))


def overrides_applied(spark, sf_dir):
    blocks = _written_blocks(spark, sf_dir)
    return enrich.apply_overrides(blocks, _overrides(blocks), spans.measured(blocks)[1]).select("book_id", "block_id", "type", "level", "confidence", "parser")


def review_queue(spark, sf_dir):
    blocks = _written_blocks(spark, sf_dir)
    return enrich.review_queue(blocks, _overrides(blocks), spans.measured(blocks)[1])


def reviewed_books(spark, sf_dir):
    return enrich.reviewed_books(_overrides(_all_blocks(spark, sf_dir)), entries(spark, sf_dir))


def illustration_injection(spark, sf_dir):
    blocks = _written_blocks(spark, sf_dir)
    return enrich.inject_illustrations(blocks, _illustrations(blocks), spans.measured(blocks)[1]).select("book_id", "block_seq", "block_id", "type", "content", "confidence", "parser")


# --- pages


def page_of_block(spark, sf_dir):
    return paginate.assign_pages(_written_blocks(spark, sf_dir)).select("book_id", "block_id", "page_index")


def paginate_books(spark, sf_dir):
    rows = paginate.pages(_all_books(spark, sf_dir), _written_blocks(spark, sf_dir))
    return rows.select("book_id", "page_index", "start_block", "end_block", F.size("block_ids").alias("n_blocks"), "char_count")


def _as_parsed(every):
    """How running values over blocks that were just parsed go: where every book is one span, they stay in the tasks that parsed them."""
    whole, tasks = parse.measured(every, spans.SPAN)
    return {"whole": whole, "tasks": None if whole else tasks}


def volume_carry(spark, sf_dir):
    every = _all_books(spark, sf_dir)
    return paginate.with_volume(parse.parse(every), **_as_parsed(every)).select("book_id", "block_id", "volume_block_id", "volume_title")


def toc_parent(spark, sf_dir):
    return paginate.toc_parents(parse.table_of_contents(_all_blocks(spark, sf_dir)))


def toc_pages(spark, sf_dir):
    blocks = _written_blocks(spark, sf_dir)
    return paginate.enrich_toc(parse.table_of_contents(blocks), paginate.assign_pages(blocks), spans.measured(blocks)[1]).select("book_id", "block_id", "level", "page_index", "page_id")


def active_toc(spark, sf_dir):
    blocks = _written_blocks(spark, sf_dir)
    return paginate.active_item(paginate.pages(_all_books(spark, sf_dir), blocks), parse.table_of_contents(blocks), spans.measured(blocks)[1])


def _asked_pages(every, asks):
    """The pages, with their volumes, of the books that are asked for: only those are parsed."""
    ids = spans.dealt(asks.select("book_id").distinct(), parse.measured(every)[1], "book_id")
    wanted = settle(every.join(ids, "book_id", "left_semi"))
    blocks = settle(paginate.with_volume(parse.parse(wanted), **_as_parsed(wanted)))
    return settle(paginate.pages(wanted, blocks))


def _page_requests(every):
    return every.select(F.concat(F.lit("r"), "book_id").alias("request_id"), "book_id", (F.length("book_id") * 2 - 3).alias("page_num"), F.when(F.col("book_id").endswith("5"), F.lit("x")).alias("volume"))


def page_fetch(spark, sf_dir):
    every = books(spark, sf_dir)
    asks = _page_requests(every)
    return paginate.fetch_page(_asked_pages(every, asks), asks)


def served_fetch(spark, sf_dir):
    """The same requests against pages that were written before, in buckets by book."""
    every = books(spark, sf_dir)
    store = Served(spark, fresh_path(spark, "served"), 8)
    store.write(compile_books(every))
    return store.fetch(_page_requests(every))


def scroll_pages(spark, sf_dir):
    ev = _events(spark, sf_dir)
    total = F.pmod(F.col("event_id"), F.lit(9)).cast("int")
    return ev.select("event_id", paginate.page_from_scroll(F.col("value") / 100, total).alias("page_index"))


def toc_ancestors(spark, sf_dir):
    return paginate.toc_ancestors(parse.table_of_contents(_all_blocks(spark, sf_dir)))


def toc_answers(spark, sf_dir):
    blocks = _written_blocks(spark, sf_dir)
    return paginate.toc_answer(parse.table_of_contents(blocks), paginate.pages(_all_books(spark, sf_dir), blocks))


def page_fetch_at(spark, sf_dir):
    every = books(spark, sf_dir)
    asks = every.select(F.col("book_id").alias("request_id"), "book_id", (F.length("book_id") - 2).alias("page_index"))
    return paginate.fetch_page_at(_asked_pages(every, asks), asks)


# --- footnotes


def _scoped(spark, sf_dir):
    every = _all_books(spark, sf_dir)
    return settle(footnotes.with_scope(parse.parse(every), **_as_parsed(every)).select("book_id", "scope", "block_seq", "block_id", "type", "content"))


def footnote_refs(spark, sf_dir):
    return footnotes.references(_scoped(spark, sf_dir))


def footnote_definitions(spark, sf_dir):
    return footnotes.index(_scoped(spark, sf_dir))


def footnote_resolve(spark, sf_dir):
    return footnotes.resolve(_scoped(spark, sf_dir)).select("book_id", "scope", "block_id", "num", "def_block_id")


def footnote_orphans(spark, sf_dir):
    return footnotes.orphans(_scoped(spark, sf_dir)).select("book_id", "block_id", "num")


def footnote_counts(spark, sf_dir):
    return footnotes.counts(_scoped(spark, sf_dir))


# --- report


def quality_by_type(spark, sf_dir):
    return report.by_type(_all_blocks(spark, sf_dir))


def low_conf_shapes(spark, sf_dir):
    return report.shapes(_all_blocks(spark, sf_dir))


def worst_documents(spark, sf_dir):
    return report.worst_books(_all_blocks(spark, sf_dir))


def quality_totals(spark, sf_dir):
    return report.totals(_all_blocks(spark, sf_dir))


# --- behaviour


def _bodies(spark):
    return spark.createDataFrame([(i, b, "u1", "agent " * 40, 1) for i, b in BODIES], "batch_id string, body string, user_id string, user_agent string, created_at long")


def event_batches(spark, sf_dir):
    return behaviour.expand_batches(_bodies(spark)).select("batch_id", "event", "session_id", "book_id", "extra_json", F.length("platform").alias("platform_chars"))


def _requests(spark, sf_dir):
    """Each user's events of a minute as the body of a request."""
    rows = _events(spark, sf_dir)
    item = F.struct("event", F.concat(F.lit("s"), "user_id").alias("sessionId"), F.col("event_id").alias("bookId"), F.struct(F.col("event_id").alias("ts")).alias("extra"))
    minute = F.date_trunc("minute", "ts")
    made = rows.groupBy("user_id", minute.alias("m")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("events"))).alias("body"), F.min("created_at").alias("created_at"))
    return made.select(F.concat_ws(":", "user_id", F.unix_millis("m").cast("string")).alias("batch_id"), "body", "user_id", F.lit("agent").alias("user_agent"), "created_at")


def event_batch_status(spark, sf_dir):
    return behaviour.batch_status(_bodies(spark).unionByName(_requests(spark, sf_dir)))


def event_append(spark, sf_dir):
    path = fresh_path(spark, "events")
    behaviour.append_events(_requests(spark, sf_dir), path, "requests")
    for _ in range(2):  # sent again, as after an answer that got lost
        behaviour.append_events(_bodies(spark), path, "bodies")
    return behaviour.client_time(behaviour.stored_events(spark, path)).select("batch_id", "event", "session_id", "book_id", "user_id", "client_ts")


def event_stream(spark, sf_dir):
    """The same bodies as a stream, sent twice, as a client does that got no answer; repeats go by session, event and client time."""
    rows, source = _requests(spark, sf_dir), fresh_path(spark, "bodies")
    rows.write.parquet(source)
    rows.write.mode("append").parquet(source)
    out, again = fresh_path(spark, "ingested"), fresh_path(spark, "single")
    stream.ingest(spark.readStream.schema(rows.schema).parquet(source), out, fresh_path(spark, "state")).awaitTermination()
    seen = behaviour.stored_events(spark, out)
    single = stream.deduplicated(spark.readStream.schema(seen.schema).parquet(out))
    single.writeStream.format("parquet").option("path", again).option("checkpointLocation", fresh_path(spark, "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(again).groupBy("event").agg(F.count("*").alias("n")).join(seen.groupBy("event").agg(F.count("*").alias("received")), "event")


def events_valid(spark, sf_dir):
    return behaviour.known_events(_events(spark, sf_dir)).select("event_id", "event", "user_id")


def event_daily_counts(spark, sf_dir):
    return behaviour.daily_counts(_events(spark, sf_dir))


def quota_decisions(spark, sf_dir):
    calls = _events(spark, sf_dir).select(F.col("event_id").alias("call_id"), F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return behaviour.quota_decisions(calls, F.lit(behaviour.GUEST_LIMIT)).select("call_id", "key", "day", "used", "allowed", "remaining")


def quota_counts(spark, sf_dir):
    return behaviour.quota_counts(_events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").alias("at")))


def quota_keys(spark, sf_dir):
    rows = _events(spark, sf_dir)
    session = F.when(F.col("event_id") % 3 == 0, F.col("event")).when(F.col("event_id") % 3 == 1, "anonymous")
    return rows.select("event_id", behaviour.quota_key(F.when(F.col("event_id") % 5 == 0, F.col("user_id")), session, F.col("extra_json")).alias("key"))


def progress_latest(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", F.col("event").alias("book_id"), F.col("extra_json").alias("data_json"), F.col("created_at").alias("updated_at"))
    return behaviour.latest_progress(rows)


def reading_duration_running(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("visit_id"), "user_id", F.col("event").alias("book_id"), F.col("created_at").alias("at"), F.floor(F.coalesce("value", F.lit(0.0)) * 10).cast("long").alias("duration_ms"))
    return behaviour.running_duration(rows).select("visit_id", "total_ms")


def resume_links(spark, sf_dir):
    n = F.col("event_id")
    rows = _events(spark, sf_dir).select(
        "event_id",
        F.col("user_id").alias("book_id"),
        F.when(n % 3 > 0, n % 7 - 1).alias("page_index"),
        F.when(n % 2 == 0, F.concat(F.lit("b/"), n.cast("string"))).alias("volume_block_id"),
        F.when(n % 4 > 0, F.lit("blk")).alias("block_id"),
        F.when(n % 5 > 0, n % 11).alias("total_pages"),
        (n % 1000 / 1000).alias("scroll_progress"),
    )
    return rows.select("event_id", behaviour.resume_link().alias("href"), behaviour.progress_label().alias("label"))


def job_patch_state(spark, sf_dir):
    n = F.col("event_id")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("created_at").alias("at"), n.alias("patch_id"), F.when(n % 2 == 0, F.col("event")).alias("status"), F.when(n % 7 == 0, F.lit("failed")).alias("error"), F.when(n % 3 == 0, F.concat(F.lit("/i/"), n.cast("string"))).alias("image_url"))
    return behaviour.job_state(rows)


def recent_items(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("item_id"), "created_at")
    return behaviour.recent(rows, "user_id", "created_at", 3).select("user_id", "item_id", "rank")


def _long_chats(spark, sf_dir):
    """Conversations, and for every third one more that holds its turns three times over."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    again = rows.where("conv_id % 3 = 0").withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select((F.col("conv_id") + 1_000_000_000).alias("conv_id"), (F.col("turn") + 100 * F.col("k")).alias("turn"), "role", "text")
    return rows.unionByName(again)


def chat_last10(spark, sf_dir):
    return behaviour.last_messages(_long_chats(spark, sf_dir)).select("conv_id", "turn", "role", "text")


def ring_neighbours(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("list_id"), F.col("n_name").alias("track_id"), F.col("n_nationkey").alias("place"))
    return behaviour.ring_neighbours(n)


def progress_of_user(spark, sf_dir):
    return behaviour.progress_of(progress_latest(spark, sf_dir), "7").select("book_id", "data_json", "updated_at")


def quota_used(spark, sf_dir):
    users = _events(spark, sf_dir).select(F.col("user_id").alias("key")).distinct()
    return behaviour.quota_used(users, quota_counts(spark, sf_dir), "2024-01-15")


def job_reuse(spark, sf_dir):
    jobs = spark.createDataFrame([("j1", "b", "k", "scene", "done", "/u"), ("j2", "b", "l", "scene", "failed", None), ("j3", "b", "m", "scene", "pending", None), ("j4", "b", "o", "scene", "done", "")], "id string, book_id string, block_id string, type string, status string, image_url string")
    asks = spark.createDataFrame([("b", x, None) for x in "klmno"], "book_id string, block_id string, type string")
    return behaviour.job_requests(asks, jobs).select("block_id", "job_id", "action")


def unique_insert(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    fresh = n.where("n_nationkey >= 5").unionByName(n.where("n_nationkey >= 5").withColumn("n_name", F.lower("n_name")))
    return behaviour.insert_unique(n.where("n_nationkey < 10"), fresh, ["n_nationkey"], "n_name")


def duplicate_keys(spark, sf_dir):
    return behaviour.duplicates(spark.read.parquet(f"{sf_dir}/nation.parquet"), ["n_regionkey"])


def catalog_sorted(spark, sf_dir):
    return catalog.page(entries(spark, sf_dir), 3, 30, *catalog.order_of("lines-asc")).select("id", "line_count")


def content_lookup(spark, sf_dir):
    own = entries(spark, sf_dir)
    return tables.content_of(own.select("id"), own.where("category <> 'en'")).select("id", F.length("content").alias("chars"))


def corpus_scan(spark, sf_dir):
    own = entries(spark, sf_dir)
    return tables.corpus(own.drop("content"), own.where("category <> 'en'")).select("id", "title", F.length("content").alias("chars"))


# --- files


def catalog_build(spark, sf_dir):
    """The catalog of a folder of files; its order is that of the titles' own collation."""
    folder = fresh_path(spark, "texts")
    for i, name in enumerate(FILES):
        write_text(spark, f"{folder}/{name}.txt", "甲\r\n乙\n" + "丙" * i)
    write_text(spark, f"{folder}/skip.md", "x")
    return catalog.build(tables.scan_texts(spark, folder)).drop("ord")


def catalog_positions(spark, sf_dir):
    """Dense places in the order of titles, over names that every collation orders alike."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.lower(F.regexp_replace("p_name", "[^A-Za-z ]", "")).alias("title"))
    return catalog.with_position(part, F.collate("title", "zh"), F.col("id")).select("id", "ord")


def title_order(spark, sf_dir):
    """Titles in the order of the catalog (by sound) and in that of the title sort (by strokes)."""
    rows = spark.createDataFrame([(t, 0) for t in ("一", "丁", "安", "中", "八", "乙", "Zeta", "alpha")], "title string, ord int")
    place = lambda *order: F.row_number().over(Window.orderBy(*order))
    return rows.select("title", place(F.collate("title", "zh")).alias("by_sound"), place(*catalog.order_of("title")).alias("by_strokes"))


def catalog_order(spark, sf_dir):
    """The rollup's rows in the order in which they come: unknown names first, then the fixed list."""
    n = len(catalog.DIVISIONS)
    kind = F.get(F.array(*map(F.lit, catalog.DIVISIONS)), F.pmod("ord", F.lit(n + 2)).cast("int"))
    rows = catalog.rollup(entries(spark, sf_dir).withColumn("category", F.coalesce(kind, F.concat(F.lit("x"), F.pmod("ord", F.lit(n + 2)).cast("string")))))
    return spark.createDataFrame([(i, r["name"], r["count"]) for i, r in enumerate(rows.collect())], "place int, name string, count long")


def catalog_results(spark, sf_dir):
    return catalog.results(catalog.in_category(entries(spark, sf_dir), "en"), 2, 30, F.col("ord")).select("id", "total")


def catalog_default(spark, sf_dir):
    """The entries of the category asked for; none is asked for, so of the first of the rollup."""
    own = entries(spark, sf_dir)
    return catalog.in_category(own, catalog.default_category(own, None)).select("id").unionByName(catalog.by_id(own, "7").select("id"))


def catalog_files(spark, sf_dir):
    """Catalog and index written and read again."""
    path = fresh_path(spark, "catalog")
    tables.write_catalog(entries(spark, sf_dir).drop("content"), path, "2026-01-01T00:00:00Z")
    index = spark.read.json(f"{path}/index").select("version", "total_entries", "build_time")
    total = index.join(spark.read.json(f"{path}/categories").agg(F.count("*").alias("names"), F.sum("count").alias("counted")), F.lit(True))
    return spark.read.json(f"{path}/entries").agg(F.count("*").alias("entries"), F.sum("line_count").alias("lines"), F.max("ord").alias("last")).join(total, F.lit(True))


def catalog_file(spark, sf_dir):
    """A catalog file with its entries in one array."""
    path = fresh_path(spark, "index.json")
    few = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey")
    made = few.select(F.struct(F.col("n_name").alias("id"), F.concat("n_name", F.lit(" 經")).alias("title"), F.lit(3).alias("lineCount"), F.col("n_nationkey").alias("size")).alias("e"), "n_nationkey")
    text = made.agg(F.to_json(F.struct(F.lit(2).alias("version"), F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "e"))), lambda x: x["e"]).alias("entries")))).head()[0]
    write_text(spark, path, text)
    return tables.read_catalog(spark, path).select("id", "title", "line_count", "size", "ord")


def content_store(spark, sf_dir):
    """Contents written by id; one is looked up in its own bucket."""
    path = fresh_path(spark, "content")
    tables.write_documents(entries(spark, sf_dir), path)
    every = spark.read.parquet(path).select("id", F.length("content").alias("chars"))
    return every.unionByName(tables.read_document(spark, path, "7").select(F.concat(F.lit("one "), "id").alias("id"), F.length("content").alias("chars")))


def overrides_file(spark, sf_dir):
    """Corrections written, changed, written back and read again; a book that loses its last one goes from the file."""
    path = fresh_path(spark, "overrides.json")
    own = _overrides(_written_blocks(spark, sf_dir))
    tables.write_overrides(own, path)
    n = F.col("book_id").try_cast("long")
    changes = own.where("type = 'subheading'").select("book_id", "key", F.lit("verse").alias("type"), F.lit(2).alias("level"), F.lit(2).cast("long").alias("reviewed_at"), (F.pmod(n, F.lit(2)) == 0).alias("remove"))
    bad = changes.limit(0).unionByName(spark.createDataFrame([("a", "1:x", "nope", 1, 3, False), ("a", "1:x", "quote", 1, 2, False), ("a", "", "quote", 1, 2, False), ("b", "1:x", "quote", None, 1, False), ("b", "1:x", "quote", None, 2, True)], "book_id string, key string, type string, level int, reviewed_at long, remove boolean"))
    tables.write_overrides(enrich.save_overrides(tables.read_side_file(spark, path, "overrides"), changes.unionByName(bad)), path)
    return tables.read_side_file(spark, path, "overrides")


def report_lines(spark, sf_dir):
    """The report as it stands in its file, line by line."""
    path = fresh_path(spark, "report.md")
    blocks = settle(_all_blocks(spark, sf_dir))
    report.write(blocks, corpus(spark, sf_dir), "2026-01-01", path)
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))


# --- look-ups


def _users(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.org")).alias("email"), F.col("c_name").alias("name"), F.lit(1).cast("long").alias("created_at"))


def user_lookups(spark, sf_dir):
    users = _users(spark, sf_dir)
    return behaviour.user_by_email(users, "  customer.000000007@EXAMPLE.org ").select("id", "email", F.lit("email").alias("by")).unionByName(behaviour.user_by_id(users, "9").select("id", "email", F.lit("id").alias("by")))


def registration(spark, sf_dir):
    """Customers of odd keys are known; all register, with addresses and passwords of every kind."""
    users = _users(spark, sf_dir)
    k = F.col("id").cast("long")
    mail = F.when(k % 5 == 0, F.concat(F.lit(" "), F.upper("email"))).when(k % 7 == 0, F.replace("email", F.lit("@"), F.lit(" "))).when(k % 11 > 0, F.col("email"))
    asks = users.select("id", mail.alias("email"), (k % 9).cast("int").alias("password_length"))
    return behaviour.valid_registration(asks, users.where(k % 2 == 1)).select("id", "status")


def progress_lookup(spark, sf_dir):
    return behaviour.progress_in(progress_latest(spark, sf_dir), "7", "page_view")


def scroll_share(spark, sf_dir):
    n = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", F.round(behaviour.scroll_progress(n % 7, n % 9), 9).alias("share"))


def job_lookups(spark, sf_dir):
    n = F.col("o_orderkey")
    jobs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(n.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("book_id"), F.concat(F.lit("b"), (n % 3).cast("string")).alias("block_id"), F.when(n % 2 == 0, "scene").otherwise("map").alias("type"))
    return behaviour.job_by_id(jobs, "7").withColumn("by", F.lit("id")).unionByName(behaviour.job_of_block(jobs, "7", "b1").withColumn("by", F.lit("block")))


# --- the store: what it holds after two rounds of changes


def _rounds(rows, n):
    return rows.where(n % 2 == 0), rows.where(n % 2 == 1)


def store_progress(spark, sf_dir):
    store = Store(spark, fresh_path(spark, "store"))
    rows = _events(spark, sf_dir).select("event_id", "user_id", F.col("event").alias("book_id"), F.col("extra_json").alias("data_json"), F.col("created_at").alias("updated_at"))
    for own in _rounds(rows, F.col("event_id")):
        store.save_progress(own)
    return store.read("reading_progress")


def store_quota(spark, sf_dir):
    store = Store(spark, fresh_path(spark, "store"))
    rows = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("at"))
    for own in (*_rounds(rows, F.col("event_id")), rows.limit(0)):
        store.use_quota(own)
    return store.read("ai_quota")


def store_users(spark, sf_dir):
    store = Store(spark, fresh_path(spark, "store"))
    users = _users(spark, sf_dir)
    spelt = users.withColumns({"email": F.concat(F.lit(" "), F.upper("email"), F.lit("\u3000")), "name": F.lit(" ")})
    for own in (users.where("id % 3 > 0"), spelt):
        store.insert_users(own)
    return store.read("users")


def store_jobs(spark, sf_dir):
    store = Store(spark, fresh_path(spark, "store"))
    text = lambda x: F.lit(x).cast("string")
    jobs = _events(spark, sf_dir).groupBy("user_id").agg(F.min("created_at").alias("created_at"))
    jobs = jobs.select(F.col("user_id").alias("id"), text("b").alias("book_id"), F.concat(F.lit("k"), "user_id").alias("block_id"), text("scene").alias("type"), F.concat(F.lit("源"), "user_id").alias("source_text"), text("pending").alias("status"), text(None).alias("error"), text("p").alias("prompt"), text(None).alias("image_url"), "created_at", F.col("created_at").alias("updated_at"))
    store.insert_jobs(jobs)
    store.insert_jobs(jobs.withColumn("id", F.concat(F.lit("again "), "id")))
    n = F.col("event_id")
    patches = _events(spark, sf_dir).select(n, F.col("user_id").alias("job_id"), F.col("created_at").alias("at"), n.alias("patch_id"), F.when(n % 2 == 0, F.col("event")).alias("status"), F.when(n % 7 == 0, F.lit("failed")).alias("error"), F.when(n % 3 == 0, F.concat(F.lit("/i/"), n.cast("string"))).alias("image_url"))
    store.patch_jobs(patches)
    return store.read("illustration_jobs").select("id", "block_id", "source_text", "status", "error", "image_url", "created_at", "updated_at")


def store_events(spark, sf_dir):
    store = Store(spark, fresh_path(spark, "store"))
    for own, ingest in ((_requests(spark, sf_dir), "a"), (_bodies(spark), "b"), (_bodies(spark), "b")):
        store.insert_events(own, ingest)
    return store.read("analytics_events").groupBy("event").agg(F.count("*").alias("n"))


# --- retrieval


def question_references(spark, sf_dir):
    asked = spark.createDataFrame(ASKED, "question_id long, q string, book_id string, book_title string, block_id string")
    return retrieve.references_of(settle(corpus(spark, sf_dir)), asked)


def query_as_typed(spark, sf_dir):
    """A simplified query finds traditional texts; by mode full text or metadata."""
    own = corpus(spark, sf_dir)
    full = search.find(own, " 灵宝领教 ").select("id", "matched_term", "match_count", F.lit("full").alias("mode"))
    other = [search.dispatch(own, "三洞", mode).select("id", F.lit(None).cast("string").alias("matched_term"), F.lit(None).cast("int").alias("match_count"), F.lit(mode + " mode").alias("mode")) for mode in ("full", "meta")]
    return full.unionByName(other[0]).unionByName(other[1])


def chapter(spark, sf_dir):
    blocks = _written_blocks(spark, sf_dir)
    toc, first = search.chapter(blocks, parse.table_of_contents(blocks), "7")
    return toc.select("block_id", F.lit("toc").alias("part")).unionByName(first.select("block_id", F.lit("block").alias("part")))


def tool_calls(spark, sf_dir):
    """What becomes of calls: found, empty, or refused for the reason given."""
    own, registry = corpus(spark, sf_dir), tools.Registry()
    registry.add(tools.Tool("entry", lambda entry_id: catalog.by_id(own, entry_id), ("entry_id",)))
    registry.add(tools.Tool("hidden", lambda entry_id: catalog.by_id(own, entry_id), ("entry_id",), "review"))
    out = []
    for i, (name, entry_id, permission) in enumerate(TOOL_CALLS):
        try:
            found = registry.call(name, {"entry_id": entry_id}, frozenset([permission]))
            out.append((i, "found" if found.head() else "empty"))
        except tools.ToolError as error:
            out.append((i, str(error)))
    return spark.createDataFrame(out, "call int, outcome string")


def footnote_bodies(spark, sf_dir):
    rows = _all_blocks(spark, sf_dir).select("book_id", "block_id", footnotes.definition(F.col("content")).alias("d")).where("d is not null")
    return rows.select("book_id", "block_id", F.array_join(F.transform("d.nums", lambda n: n.cast("string")), ",").alias("nums"), "d.body")


def footnote_segments(spark, sf_dir):
    rows = _all_blocks(spark, sf_dir).where(F.col("content").rlike(footnotes.MARK) & ~footnotes.is_definition(F.col("content")))
    return rows.select("book_id", "block_id", F.posexplode(footnotes.segments(F.col("content"))).alias("place", "s")).select("book_id", "block_id", "place", "s.kind", "s.value", "s.num")


def footnote_display(spark, sf_dir):
    return footnotes.display_type(_all_blocks(spark, sf_dir)).groupBy("type", "display").agg(F.count("*").alias("n"))


def url_parts(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", T.url_component("p_name").alias("url"))


def queries() -> dict:
    found = (
        catalog_rollup, catalog_summary, catalog_filter_page, catalog_metadata_search, catalog_facets, tag_counts, tag_rules,
        parse_names, size_labels, entry_profile, adjacent_entries, related_entries, title_picks, daily_pick, sitemap,
        fulltext_search, fulltext_hits, fulltext_total, in_book_search, highlight_pieces, visible_text, whole_text,
        concept_terms, parse_blocks, parse_fixtures, parse_toc, parse_stats, overrides_applied, review_queue, reviewed_books,
        illustration_injection, page_of_block, paginate_books, volume_carry, toc_parent, toc_pages, active_toc, page_fetch,
        scroll_pages, footnote_refs, footnote_definitions, footnote_resolve, footnote_orphans, quality_by_type,
        low_conf_shapes, worst_documents, quality_totals, event_batches, events_valid, event_daily_counts, quota_decisions,
        quota_counts, quota_keys, progress_latest, reading_duration_running, resume_links, job_patch_state, recent_items,
        chat_last10, ring_neighbours, toc_ancestors, toc_answers, page_fetch_at, footnote_counts, progress_of_user, quota_used,
        job_reuse, unique_insert, duplicate_keys, catalog_sorted, content_lookup, corpus_scan,
        event_batch_status, event_append, event_stream, catalog_build, catalog_positions, title_order, catalog_order,
        catalog_results, catalog_default, catalog_files, catalog_file, content_store, overrides_file, report_lines,
        user_lookups, registration, progress_lookup, scroll_share, job_lookups, question_references, query_as_typed,
        chapter, tool_calls, footnote_bodies, footnote_segments, footnote_display, url_parts,
        store_progress, store_quota, store_users, store_jobs, store_events,
        indexed_hits, indexed_short, indexed_page, indexed_metadata, fulltext_after, rollup_by_sound, catalog_of_pages, jobs_of_orders, served_fetch,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from inkstone.oracle import SQL

    return dict(SQL)
