import random

import numpy as np
import pytest

from inkstone.llm import packing

SF = "/root/testdata/sf0.01"


def restored(spark, rows):
    """The bytes of each document, from its packed pieces; checks the rows' shape on the way."""
    words = packing.vocabulary(spark)
    decode, end = packing.encoding(words).decode_bytes, words.count(b"\n")
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == packing.LENGTH and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= packing.LENGTH
        assert r.resets == r.cu_seqlens[:-1] and r.n_segments == len(r.doc_ids) == len(r.starts) and (ids[r.n_tokens :] == end).all()
        for k in range(r.n_segments):
            pieces.setdefault(r.doc_ids[k], []).append((r.starts[k], ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]))
    out = {}
    for doc, own in pieces.items():
        own.sort(key=lambda p: p[0])
        assert [s for s, _ in own] == list(np.cumsum([0, *(len(x) for _, x in own)])[:-1])
        ids = np.concatenate([x for _, x in own])
        assert ids[-1] == end and (ids[:-1] != end).all()
        out[doc] = decode(ids[:-1].tolist()).decode()
    return out


def test_query_round_trip(spark):
    rows = packing.op9_token_packing(spark, SF).collect()
    assert restored(spark, rows) == {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sum(r.n_tokens for r in rows) > 0.95 * packing.LENGTH * (len(rows) - 8)


def plain(sizes, length):
    rows = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(length - sum(sizes[j] for j in r), k) for k, r in enumerate(rows) if sum(sizes[j] for j in r) + sizes[i] <= length]
        if fits:
            room = min(fits)[0]
            rows[min(k for r, k in fits if r == room)].append(i)
        else:
            rows.append([i])
    return rows


@pytest.mark.parametrize("length", [1, 7, 64, 100])
def test_best_fit_uses_the_tightest_row(length):
    rng = random.Random(length)
    for _ in range(60):
        sizes = [rng.randint(1, length) for _ in range(rng.randrange(60))]
        got = packing.best_fit(sizes, length)
        assert sorted(i for r in got for i in r) == list(range(len(sizes))) and all(sum(sizes[i] for i in r) <= length for r in got)
        assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(sum(sizes[i] for i in r) for r in plain(sizes, length))


def test_edges(spark):
    long = "word " * 30_000
    texts = {1: "", 2: "é中\x00\r\n <|endoftext|>", 3: long, 4: "x" * 20_000, 5: "\n" * 5000}
    rows = [(k, v, "p") for k, v in texts.items()] + [(6, None, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pack_id string")
    assert restored(spark, packing.pack(df, window=5000).collect()) == texts
    twice = packing.pack(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")).collect()
    assert sum(r.n_segments for r in twice) == 3
    assert packing.pack(df.limit(0)).collect() == []


def test_written_matrix(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "five six")], "doc_id long, text string").coalesce(1)
    packing.write(packing.pack(df, length=16), str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    ids, positions, segments = packing.read_matrix(rows, 16)
    assert ids.shape == positions.shape == (len(rows), 16)
    for i, r in enumerate(rows):
        assert [int(p) for p in np.flatnonzero((positions[i] == 0) & (segments[i] > 0))] == r.resets
        assert (segments[i] > 0).sum() == r.n_tokens and segments[i].max() == r.n_segments
    empty = packing.read_matrix([], 16)
    assert empty[0].shape == (0, 16)
