import random
import re

import compare

from inkstone.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    got = compare.spark_rows(D.op2_benchmark_decontamination(spark, SF))
    assert got == compare.sql_rows(compare.connect(SF), D.OP2_SQL)
    assert sum(r[1] is True for r in got[1]) or any(True in r for r in got[1])


def brute(docs, items):
    """Pairs whose best run along any alignment, with a seed on it, reaches the bound; for brief items the matched words count too."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for i, text in docs:
        for j, other in items:
            a, b = cut(text), cut(other)
            best = 0
            for shift in range(-len(b), len(a)):
                same = [(p + shift) in range(len(a)) and a[p + shift] == b[p] for p in range(len(b))]
                inside = [p for p in range(len(b)) if p + shift in range(len(a))]
                if not any(all(p + k < len(b) and same[p + k] for k in mask) and p + D.SPAN <= len(b) and p + shift >= 0 and p + shift + D.SPAN <= len(a) for p in range(len(b)) for mask in (D.MASKS if len(b) <= D.BRIEF else D.SPACED)):
                    continue
                run = 0
                for p in inside:
                    run = max(0, run + (1 if same[p] else -D.PENALTY))
                    best = max(best, run)
                if len(b) <= D.BRIEF:
                    best = max(best, sum(same))
            if best and best >= min(D.LEAST, -(-len(b) * 3 // 4)):
                out.add((i, j, best))
    return out


def test_substitutions(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, [word() for _ in range(rng.choice([7, 8, 9, 11, 15, 30]))]) for k in range(12)]
    docs = []
    for n in range(60):
        w = [word() for _ in range(rng.randrange(5, 60))]
        passage = list(items[n % 12][1])
        for _ in range(rng.choice([0, 1, 3, 6])):
            passage[rng.randrange(len(passage))] = word()
        at = rng.randrange(len(w) + 1)
        docs.append((n, ". ".join(w[:at] + passage[rng.choice([0, 0, 3]) :] + w[at:]).upper() if n % 2 else " ".join(w)))
    items = [(k, " ".join(w)) for k, w in items]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item long")
    t = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, id long")
    found = {(r.id, r.item, r.overlap) for r in D.overlaps(d, t).collect()}
    assert found == brute(docs, items) and found


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten eleven y"), (2, "one two three")], "doc_id long, text string")
    want = [tuple(r) for r in D.overlaps(docs, items).collect()]
    monkeypatch.setattr(D, "BROADCAST", 0)
    assert [tuple(r) for r in D.overlaps(docs, items).collect()] == want == [(1, 1, 11, 11)]


def test_edges(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, None, "a"), (3, "", "a"), (None, text, "a"), (4, "z " * 100_000 + text, "a"), (5, "one two", "a")], "doc_id long, text string, item_text string")
    items = spark.createDataFrame([(1, text), (1, text), (2, None), (None, text), (3, ""), (4, "one two")], "item_id long, text string")
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 5, None]
    assert D.clean(docs, items.limit(0)).count() == 7 and D.clean(docs.limit(0), items).count() == 0


def test_short_items(spark):
    """Items of one to six words are found whole; one word replaced anywhere in seven to eleven is tolerated."""
    short = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 12)}
    items = spark.createDataFrame([(n, " ".join(w)) for n, w in short.items()], "item_id long, text string")
    docs, want = [], set()
    for n, w in short.items():
        passages = [(w, n), *(([*w[:k], "x", *w[k + 1 :]], n - 1) for k in range(n)), (["x", *w[1:-1], "x"], n - 2), (w[1:], n - 1)]
        for v, (passage, matched) in enumerate(passages):
            docs += [(1000 * n + 10 * v, " ".join(["a b c d", *passage, "e f g h"])), (1000 * n + 10 * v + 1, " ".join(passage))]
            # Whole below a mask's span; from there the operator's bound.
            if matched == n or n >= D.SPAN and matched >= -(-n * 3 // 4):
                want |= {(1000 * n + 10 * v + k, n, matched) for k in (0, 1)}
    docs.append((1, "What is the capital of France? " + "z " * 20 + "what is the capital of France"))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = items.unionByName(spark.createDataFrame([(50, "what is the capital of France")], items.schema))
    found = {(r.id, r.item, r.overlap) for r in D.overlaps(docs, items).collect()}
    assert found == want | {(1, 50, 6)}
    assert {(r.id, r.item, r.overlap) for r in D.overlaps(docs, items, fewest=D.FEWEST).collect()} == {x for x in found if x[1] >= D.FEWEST}


def test_short_items_match_sql(spark, tmp_path):
    """The query and its SQL on a benchmark of one to twelve words, whole and with a word replaced."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefgh")
    items = [(k, " ".join(word() for _ in range(1 + k % 12))) for k in range(60)] + [(99, None), (100, ".,")]
    docs = []
    for n in range(300):
        w = [word() for _ in range(rng.randrange(30))]
        passage = (items[n % 60][1]).split()
        if n % 3:
            passage[rng.randrange(len(passage))] = "zz"
        at = rng.randrange(len(w) + 1)
        docs.append((n, " ".join(w[:at] + passage + w[at:]) if n % 50 else None))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = compare.duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = compare.spark_rows(D.op2_benchmark_decontamination(spark, str(tmp_path)))
    assert got == compare.sql_rows(con, D.OP2_SQL) and any(True in r for r in got[1])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four", 5, 6), (2, "x", 7, 8)], "doc_id long, text string, _bad long, _BAD_ long")
    kept = D.clean(docs.withColumnRenamed("_BAD_", "__bad"), spark.createDataFrame([(1, "one two three four")], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "_bad", "__bad"] and [tuple(r) for r in kept.collect()] == [(2, "x", 7, 8)]
