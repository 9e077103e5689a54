import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import linking, minhash
from inkstone.llm.wordhash import document_words

SF = "/root/testdata/sf0.01"


def brute(rows, k=4, percent=80):
    """{id: (size, component)} by comparing every pair."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(df):
    return {r["id"]: (r["n_shingles"], r["component"]) for r in df.collect()}


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = minhash.op1_minhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_blocks_lose_no_link(spark, monkeypatch):
    """Groups of many blocks, and several components in one group, give the components of all pairs."""
    monkeypatch.setattr(minhash, "SIGNATURE_BLOCK", 4)
    monkeypatch.setattr(minhash, "SET_BLOCK", 4)
    rng = random.Random(3)
    rows = []
    for group in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(minhash.near_duplicates(df)) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (None, "a b c d e"), (8, "a b c d e"), (8, "a b c d e")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, component long, key string")
    out = sorted(((r.id, r.n_shingles, r.component, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert out == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (None, 2, None, False), (8, 2, 6, False), (8, 2, 6, False)], key=str)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_pigeonhole():
    """Any two signatures within REACH share a key."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 65536, (500, minhash.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for i in range(500):
        at = rng.choice(minhash.SYMBOLS, minhash.REACH, replace=False)
        b[i, at] += 1
    assert (minhash.keys_of(a) == minhash.keys_of(b)).any(1).all()


def test_words():
    texts = ["Ab cd\x0bef", None, "", "gh", "ij  Kl"]
    got = [(row, len(words), cut.tolist()) for row, words, cut in document_words(pa.array(texts))]
    assert got == [(0, 6, [0, 3, 3, 3, 4, 6])]
    one = next(document_words(pa.array(["ab CD", "cd"])))[1]
    assert one[1] == one[2] != one[0]


@pytest.mark.parametrize("n", [2, 9])
def test_span(n):
    links = linking.span(n, lambda i: np.arange(i + 1, min(i + 2, n)), None, None)
    assert links.tolist() == [[i, 0] for i in range(1, n)]
    only_new = linking.span(n, lambda i: np.arange(i + 1, n), np.arange(n) == n - 1, np.zeros(n))
    assert only_new.tolist() == []


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, text), (2, text.upper()), (3, text + " end")], "doc_id long, text string")
    assert result(minhash.near_duplicates(df)) == {1: (299_997, 1), 2: (299_997, 1), 3: (299_998, 1)}
