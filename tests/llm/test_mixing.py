import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkstone.llm import mixing

SF = "/root/testdata/sf0.01"


def raked(cells, wants):
    """Plain iterative proportional fitting of {(source, lang, topic): tokens}."""
    weight = {c: 1.0 for c in cells}
    for _ in range(400):
        for d in range(3):
            now = defaultdict(float)
            for c, n in cells.items():
                now[c[d]] += n * weight[c]
            for c in cells:
                weight[c] = weight[c] * wants[d][c[d]] / now[c[d]] if now[c[d]] else 0.0
    return weight


def targets(cells, powers):
    total, out = sum(cells.values()), []
    for d in range(3):
        own = defaultdict(float)
        for c, n in cells.items():
            own[c[d]] += n / total
        raw = {v: s ** powers[d] for v, s in own.items()}
        out.append({v: r / sum(raw.values()) * total for v, r in raw.items()})
    return out


def test_query_matches_plain_raking(spark):
    rows = mixing.op4_source_mixing(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.n_tokens == len(re.findall(r"[^ \t\n\x0b\f\r]+", texts[r.doc_id])) for r in rows)
    cells = defaultdict(int)
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    cells = {c: n for c, n in cells.items() if n}
    weight = raked(cells, targets(cells, list(mixing.FLATTEN.values())))
    most = max(weight.values())
    for r in rows:
        if r.n_tokens:
            assert r.weight == pytest.approx(weight[r.source, r.lang, r.topic], rel=1e-3, abs=2e-6)
            assert r.probability == pytest.approx(weight[r.source, r.lang, r.topic] / most, rel=1e-3, abs=2e-6)


def test_given_targets(spark):
    rows = [(i, "w " * (1 + i % 5), ["a", "a", "a", "b"][i % 4], ["x", "y"][i // 4 % 2], ["p", "q"][i // 8 % 2]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    dims = {d: F.col(d) for d in mixing.DIMENSIONS}
    want = {"source": {"a": 1, "b": 1}, "lang": {"x": 3, "y": 1}, "topic": {"p": 0.2, "q": 0.8}}
    out = mixing.weighted(df, want, dims=dims).collect()
    for d, shares in want.items():
        expected = defaultdict(float)
        for r in out:
            expected[r[d]] += r._probability * r._tokens
        total = sum(expected.values())
        for v, s in shares.items():
            assert expected[v] / total == pytest.approx(s / sum(shares.values()), rel=1e-4)
    kept = mixing.sample(df, want, dims=dims)
    assert kept.columns == df.columns
    tokens = kept.groupBy("source").agg(F.sum(mixing.n_tokens("text")).alias("n")).collect()
    share = {r.source: r.n for r in tokens}
    assert share["a"] / sum(share.values()) == pytest.approx(0.5, abs=0.05)
    assert sorted(r.doc_id for r in mixing.sample(df, want, dims=dims).collect()) == sorted(r.doc_id for r in kept.collect())


def test_edges(spark, monkeypatch):
    rows = [(1, None, "s", "en", 1), (2, "", None, None, 1), (3, "a b", None, "en", 1), (None, "a", "s", None, 1), (3, "a b", None, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight int")
    for bound in (mixing.BROADCAST, 0):
        monkeypatch.setattr(mixing, "BROADCAST", bound)
        out = mixing.weighted(df).collect()
        assert len(out) == 5
        assert all((r._probability > 0) == (r._tokens > 0) and not (r._kept and r._tokens == 0) for r in out)
    none = mixing.sample(df.limit(0))
    assert none.columns == df.columns and none.collect() == []
    zero = mixing.weighted(df, {"lang": {"de": 1.0}}).collect()
    assert not any(r._kept for r in zero)


def test_topics_against_plain_counts(spark):
    """Topics by the definition, from every word of every document."""
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").withColumn("h", F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))).collect()}
    total = defaultdict(lambda: [0, 0, 0])
    for r in texts.values():
        for k, n in enumerate((len(r.h), sum(h & 1 for h in r.h), sum(h >> 1 & 1 for h in r.h))):
            total[r.lang][k] += n
    found = {r.doc_id: r for r in mixing.op4_source_mixing(spark, SF).collect()}
    for i, r in texts.items():
        n, one, two = total[r.lang]
        sides = (sum(h & 1 for h in r.h) / len(r.h) > one / n, sum(h >> 1 & 1 for h in r.h) / len(r.h) > two / n)
        assert found[i].topic == f"t{sides[0] + 2 * sides[1]}", i
    assert len({r.topic for r in found.values()}) == 4 and all(r.deviation < 1e-5 for r in found.values())


def test_budget_and_clashing_columns(spark):
    rows = [(i, "w " * (1 + i % 5), ["a", "b"][i % 2], "x", 77, "y") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _tokens long, _MIX string")
    kept = mixing.sample(df)
    assert kept.columns == df.columns and {(r._tokens, r._MIX) for r in kept.collect()} == {(77, "y")}
    out = mixing.weighted(df, budget=1500).collect()
    assert sum(r._probability * r._tokens for r in out) == pytest.approx(1500, rel=1e-3) and {r._tokens for r in out} == {1, 2, 3, 4, 5}


def test_a_rare_cell_does_not_set_the_size(spark):
    rows = [(i, "w " * 50, ["a", "b"][i % 4 == 0], ["x", "y"][i % 3 == 0]) for i in range(3000)] + [(9000, "w " * 20, "z", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.weighted(df).collect()
    cells = defaultdict(int)
    for r in out:
        cells[r._source, r._lang, r._topic] += r._tokens
    want = targets(cells, list(mixing.FLATTEN.values()))
    expected = [defaultdict(float) for _ in range(2)]
    for r in out:
        assert 0 < r._probability <= 1
        for d, v in enumerate((r._source, r._lang)):
            expected[d][v] += r._probability * r._tokens
    total = sum(cells.values())
    for d in range(2):
        assert sum(expected[d].values()) == pytest.approx(mixing.SHARE * total, rel=1e-4)
    # The rare document is kept whole; the other values share the rest in the targets' proportions.
    assert all(r._probability > 0.999 and r._kept for r in out if r.doc_id == 9000)
    assert expected[0]["a"] / expected[0]["b"] == pytest.approx(want[0]["a"] / want[0]["b"], rel=1e-3)
    assert expected[1]["x"] / expected[1]["y"] == pytest.approx(want[1]["x"] / want[1]["y"], rel=1e-3)
    assert sum(r._kept for r in out) > 600
    half = mixing.weighted(df, share=0.5).collect()
    assert sum(r._probability * r._tokens for r in half) == pytest.approx(0.5 * total, rel=1e-4)


def test_languages_without_words_and_very_long_texts(spark):
    """A language whose texts hold no word has no shares; every word of a long text counts."""
    rows = [(1, " ", "s", "xx"), (2, None, "s", "yy"), (3, "a b " * 300_000, "s", "en"), (4, "a c", "t", "en")]
    out = {r.doc_id: r for r in mixing.weighted(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert [out[k]._tokens for k in (1, 2, 3, 4)] == [0, 0, 600_000, 2] and not out[1]._kept and not out[2]._kept
