"""The parser's rules on the fixture books, its runs of verse against a sequential model, and invariants."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkstone import queries as Q
from inkstone.operators import enrich, paginate, parse, spans

CJK = "[㐀-鿿]"


@pytest.fixture(scope="module")
def blocks(spark):
    return parse.parse(Q.fixture_books(spark)).cache()


def shown(blocks, book):
    return [(r.type, r.level, r.confidence, r.source_start, r.source_end) for r in blocks.where(f"book_id = '{book}'").orderBy("block_seq").collect()]


def test_volume_and_paragraphs(blocks):
    assert shown(blocks, "f1") == [("heading", 1, 0.95, 0, 0), ("editor-note", None, 0.9, 2, 2), ("heading", 2, 0.9, 4, 4), ("subheading", 3, 0.8, 6, 6), ("paragraph", None, 0.98, 7, 7), ("paragraph", None, 0.98, 8, 8)]


def test_labels_notes_and_volume_end(blocks):
    kinds = [(t, lv) for t, lv, *_ in shown(blocks, "f2")]
    assert kinds == [("heading", 1), ("heading", 2), ("subheading", 4), ("paragraph", None), ("subheading", 4), ("paragraph", None), ("paragraph", None), ("paragraph", None), ("original-note", None), ("original-note", None)]


def test_sections_sequences_directives(blocks):
    kinds = [(t, lv, c) for t, lv, c, *_ in shown(blocks, "f3")]
    assert kinds == [("heading", 1, 0.95), ("subheading", 3, 0.9), ("subheading", 3, 0.8), ("paragraph", None, 0.98), ("subheading", 4, 0.85), ("paragraph", None, 0.98), ("annotation", None, 0.8), ("paragraph", None, 0.98)]


def test_empty_book_has_no_block(blocks):
    assert shown(blocks, "f5") == []


def test_byte_order_mark_is_trimmed(blocks):
    assert blocks.where("book_id = 'f7' and block_seq = 0").head().content == "三洞珠囊"


def test_contents(spark, blocks):
    toc = parse.table_of_contents(blocks)
    assert [r.block_seq for r in toc.where("book_id = 'f2'").orderBy("block_seq").collect()] == [0, 1]
    assert [r.block_seq for r in toc.where("book_id = 'f3'").orderBy("block_seq").collect()] == [0, 1, 2]


LINES = ["天地玄宗", "萬炁本根", "三洞珠囊卷之一", "卷之一竟甲", "某書卷上竟", "", "　　縮排正文。", "短句", "經名：某。", "又", "頌曰", "日月星辰"]


def model(lines):
    """(type, start, end) of blocks, read line by line."""
    out, i, titled = [], 0, False
    text = [x.strip("　 ") for x in lines]
    free = [not x.startswith("　") for x in lines]
    verse = [f and bool(re.fullmatch(CJK + "{4,10}[，、。]?", t)) for f, t in zip(free, text)]
    volume = f"卷(之{parse.NUMERAL}|{parse.NUMERAL}|[上中下])"
    while i < len(lines):
        t, f = text[i], free[i]
        j = i
        if not t:
            i += 1
            continue
        if not titled:
            kind, titled = "heading", True
        elif re.match("(經名|经名|底本出處|底本出处)[：:]", t):
            kind = "editor-note"
        elif f and len(t) <= 24 and re.fullmatch(".{0,16}?" + volume + "竟", t):
            kind = "original-note"
        elif f and len(t) <= 20 and re.fullmatch(".{0,16}?" + volume, t):
            kind = "heading"
        else:
            kind = None
            if verse[i]:
                while j + 1 < len(lines) and verse[j + 1]:
                    j += 1
                kind = "verse" if j > i else None
            kind = kind or "other"
        out.append((kind, i, j))
        i = j + 1
    return out


def test_verse_runs_match_a_sequential_reading(spark):
    rng = random.Random(5)
    cases = [[rng.choice(LINES) for _ in range(rng.randrange(1, 14))] for _ in range(300)]
    rows = [(str(i), "", "\n".join(c)) for i, c in enumerate(cases)]
    found = {}
    for r in parse.parse(spark.createDataFrame(rows, "book_id string, title string, source string")).orderBy("book_id", "block_seq").collect():
        kind = r.type if r.type in ("heading", "editor-note", "verse") or r.type == "original-note" else "other"
        found.setdefault(r.book_id, []).append((kind, r.source_start, r.source_end))
    assert found == {str(i): m for i, c in enumerate(cases) if (m := model(c))}


@pytest.mark.parametrize("segment", [1, 2, 3, 5])
def test_blocks_do_not_depend_on_segments(spark, segment):
    """Runs over several segments, segments of nothing but verse or blank lines, titles and volumes that open a run."""
    rng = random.Random(6)
    kinds = [LINES, ["天地玄宗", "萬炁本根", "日月星辰"], ["", "天地玄宗"], ["天地玄宗", "三洞珠囊卷之一", "日月星辰", "萬炁本根"]]
    cases = [[rng.choice(rng.choice(kinds)) if rng.random() < 0.3 else rng.choice(kinds[1]) for _ in range(rng.randrange(1, 16))] for _ in range(150)] + [[""] * 7, ["天地玄宗"] * 9]
    books = spark.createDataFrame([(str(i), "", "\n".join(c)) for i, c in enumerate(cases)], "book_id string, title string, source string")
    shape = lambda df: sorted(map(tuple, df.collect()))
    assert shape(parse.parse(books, segment)) == shape(parse.parse(books))


def test_one_book_with_half_of_all_lines_is_spread(spark):
    big = "\n".join(["某某經", *(f"　　第{i}句經文。" for i in range(2000))])
    books = spark.createDataFrame([("big", "某某經", big)] + [(str(i), "", "短句甲\n　　正文。\n" * 10) for i in range(100)], "book_id string, title string, source string")
    lines = parse.source_lines(books, 100)
    # As dealt, before adaptive execution puts small partitions together.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = lines.where("book_id = 'big'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) >= 6 and max(r.n for r in tasks) < 1000
    found = parse.parse(books, 100).where("book_id = 'big'").agg(F.count("*").alias("n"), F.max("block_seq").alias("last")).head()
    assert (found.n, found.last) == (2001, 2000)


def test_every_line_with_text_is_in_one_block(spark):
    books = Q.books(spark, "/root/testdata/sf0.001")
    lines = parse.source_lines(books).where("text <> ''").count()
    spans = parse.parse(books).selectExpr("sum(source_end - source_start + 1) as n").head().n
    assert spans == lines


def test_more_text_is_parsed_by_more_tasks(spark, monkeypatch):
    """What a task sorts doesn't grow with the input, and the blocks are the same."""
    books = Q.books(spark, "/root/testdata/sf0.001")
    chars = books.agg(F.sum(F.length("source") + F.length("title"))).head()[0]
    shape = lambda df: sorted(map(tuple, df.collect()), key=repr)
    before = shape(parse.parse(books))
    monkeypatch.setattr(parse, "SHARE", chars // 30, raising=False)
    for segment in (parse.SEGMENT, 20):
        found = parse.parse(books, segment)
        assert shape(found) == before
        if segment == parse.SEGMENT:
            assert found.rdd.getNumPartitions() >= 30


def pages_model(blocks):
    out, start, chars = [], 0, 0
    for i, (n, head) in enumerate(blocks):
        chars += n
        if i > start and chars >= 1400 and head:
            out.append((start, i - 1))
            start, chars = i, n
        elif chars >= 2200 and i > start:
            out.append((start, i))
            start, chars = i + 1, 0
    if start < len(blocks):
        out.append((start, len(blocks) - 1))
    return out or [(0, 0)]


def test_pages_match_a_sequential_reading(spark):
    rng = random.Random(8)
    cases = [[(rng.choice([5, 300, 800, 1400, 2200, 3000]), rng.random() < 0.3) for _ in range(rng.randrange(0, 12))] for _ in range(150)]
    cases += [[(3000, False)], [(3000, False), (5, False)]]
    rows = [(str(b), i, f"{b}-b{i}", "heading" if h else "paragraph", "x" * n) for b, c in enumerate(cases) for i, (n, h) in enumerate(c)]
    blocks = spark.createDataFrame(rows, "book_id string, block_seq int, block_id string, type string, content string")
    books = spark.createDataFrame([(str(b),) for b in range(len(cases))], "book_id string")
    found = {}
    for r in paginate.pages(books, blocks).orderBy("book_id", "page_index").collect():
        found.setdefault(r.book_id, []).append((r.start_block, r.end_block))
    assert found == {str(b): pages_model(c) for b, c in enumerate(cases)}


def test_overrides(spark, blocks):
    schema = "book_id string, key string, type string, level int, reviewed_at long"
    one = spark.createDataFrame([("f4", "2:短句甲", "paragraph", None, 1), ("f4", "999:x", "verse", None, 1)], schema)
    fixed = enrich.apply_overrides(blocks, one)
    assert shown(fixed, "f4") == [("heading", 1, 0.95, 0, 0), ("paragraph", None, 1.0, 2, 2), ("paragraph", None, 0.98, 3, 3)]
    assert parse.table_of_contents(fixed).where("book_id = 'f4'").count() == 1
    changes = spark.createDataFrame([("f4", "2:短句甲", None, None, 2, True), ("f1", "k", "verse", None, 3, False), ("f1", "j", "image", None, 3, False)], schema + ", remove boolean")
    assert sorted((r.book_id, r.key) for r in enrich.save_overrides(one, changes).collect()) == [("f1", "k"), ("f4", "999:x")]


@pytest.mark.parametrize("reach,span", [(3000, 50), (2500, 7), (100_000, 20_000)])
def test_pages_of_one_book_with_half_of_all_lines(spark, monkeypatch, reach, span):
    """A long book is cut in parts that don't show in its pages; blocks that are long, empty, or all headings."""
    monkeypatch.setattr(spans, "SPAN", span)
    rng = random.Random(1)
    books = {f"b{k}": [(rng.choice([0, 1, 40, 300, 900, 2500, 9000]), rng.random() < 0.3) for _ in range(n)] for k, n in enumerate([900, 1, 2, 400, 399, 1])}
    books |= {"c0": [(1, False)] * 5000, "c1": [(0, True)] * 30, "c2": [(30_000, True)] * 9, "c3": [(1399, True), (1, True)] * 40, "c4": [(2200, False), (7, True)] * 30, "c5": [(8000, False), (10, True), (0, True)] * 20}
    rows = [(b, i, "heading" if head else "paragraph", "x" * length) for b, sizes in books.items() for i, (length, head) in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "book_id string, block_seq int, type string, content string")
    pages = {}
    for r in paginate.assign_pages(df, reach).select("book_id", "block_seq", "page_index").collect():
        pages.setdefault(r.book_id, {}).setdefault(r.page_index, []).append(r.block_seq)
    assert {b: [min(own[p]) for p in sorted(own)] for b, own in pages.items()} == {b: [first for first, _ in pages_model(sizes)] for b, sizes in books.items()}
    plan = paginate.assign_pages(df, reach)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Python" not in plan


def test_running_values_do_not_depend_on_spans(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, rng.choice([None, None, i]), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, place int, v int, n int")
    want = {}
    for k in "ab":
        total, last, first = 0, None, None
        for _, place, v, n in (r for r in rows if r[0] == k):
            last, first = (v, first if first is not None else v) if v is not None else (last, first)
            want[place] = (total, total + n, last, first)
            total += n
    for span in (1, 7, 1000):
        got = spans.sum_before(spans.sum_before(df, "k", "place", "s", F.col("n"), span), "k", "place", "t", F.col("n"), span, here=True)
        got = spans.seen(got, "k", "place", {"last": F.col("v")}, {"first": F.col("v")}, span)
        assert got.columns == [*df.columns, "s", "t", "last", "first"]
        assert {r.place: (r.s, r.t, r.last, r["first"]) for r in got.collect()} == want
