import re

import corpus_pipeline as P
from test_minhash import brute

from inkstone.llm import packing

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage on all that the one before kept, against plain versions of what it must do."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        docs = P.settle(stage(spark, docs, SF))
        assert docs.columns == columns, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, single, clean, mixed = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(i in quality for i, q in labels.items() if q == 1) > 0.98 * sum(q == 1 for q in labels.values())
    assert sum(i in quality for i, q in labels.items() if q == 0) < 0.1 * sum(q == 0 for q in labels.values())
    want = brute(list(quality.items()), k=5)
    assert set(single) == {i for i, (_, c) in want.items() if c == i}
    cut = lambda t: " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w)
    items = [cut(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(item in cut(t) for t in clean.values() for item in items)
    assert any(item in cut(t) for t in single.values() for item in items) and set(clean) <= set(single) and set(mixed) <= set(clean)
    rows = packing.pack(docs).collect()
    assert {i for r in rows for i in r.doc_ids} == set(mixed)


def test_run_gives_the_last_stage(spark):
    rows = P.run(spark, SF)
    assert rows.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")] and rows.count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_nulls_and_repeats(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(1, words, "en", "a", 3), (1, words, "en", "a", 3), (2, words + " more", None, None, None), (3, None, "en", "a", 0), (4, "", "en", None, 0), (None, words, "de", "b", 9), (5, words[:100], "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(None, 1, 0), (1, 1, 0), (1, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, words), (2, words[:90]), (2, words[:90])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns, counts = docs.columns, []
    for _, stage in P.STAGES[:-1]:
        docs = P.settle(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0


def test_clashing_columns(spark):
    """Columns named like the operators' own come through every stage unchanged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    names = ["_gone", "_bad", "_tokens", "_Mix", "_own", "_cell", "_centre", "id", "score", "kept", "weight", "component", "text_", "seed"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, docs["doc_id"] * 100 + k)
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = P.settle(stage(spark, docs, SF))
        assert docs.columns == columns
    rows = docs.collect()
    assert rows and all(r[name] == r.doc_id * 100 + k for r in rows for k, name in enumerate(names))
    assert P.STAGES[-1][1](spark, docs, SF).count() > 0
