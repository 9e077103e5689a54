import random

import pytest
from pyspark.sql import functions as F

from inkstone.llm import tokencounts as T

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"
#: Pieces of contractions, white space of several kinds, special strings, letters that libraries class apart.
PARTS = ["a", "e", "r", "l", "v", "t", "s", "'", " ", " ", "\n", "\t", "\r\n", "é", "中", "!", "1", "<|endoftext|>", "<|", "the", "ing", "　", "😀", "L", "ա՘", "౜", "₏", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(T.path())
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def model(spark):
    return T.prefixes_of(T.vocabulary(spark, T.path()))


def plain(encode, text, limit):
    found = [encode(text[:p]) for p in range(len(text) + 1)]
    return found, (found[-1], max((p for p, n in enumerate(found) if n <= limit), default=0))


def test_every_prefix_is_exact(model, encode):
    rng = random.Random(11)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        limit = rng.randrange(8)
        found, best = plain(encode, text, limit)
        assert model.at_every_prefix(text) == found, text
        assert model.fitting(text, limit) == best, (text, limit)


def test_random_letters_and_bytes(model, encode):
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(97, 123), rng.randrange(160, 0x3000), rng.randrange(0x4E00, 0x4F00)])) for _ in range(40))
        assert model.at_every_prefix(text) == [encode(text[:p]) for p in range(len(text) + 1)], text


def test_query_against_the_library(spark, encode):
    got = {r.doc_id: r for r in T.op11_token_counts(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, n = got[d.doc_id], encode(d.text)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), n, n > 512)
        fit = r.fit_chars
        assert fit == len(d.text) if n <= 512 else encode(d.text[:fit]) <= 512 < encode(d.text[: fit + 1])


def test_stored_counts_answer_cuts_and_budgets(spark, encode):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(30)) for _ in range(20)] + ["", "a", None]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = T.stored(df).select("doc_id", "counts", *(T.tokens_of_prefix(F.col("counts"), F.lit(p)).alias(f"p{p}") for p in (-1, 0, 5, 999)), *(T.chars_within(F.col("counts"), F.lit(b)).alias(f"b{b}") for b in (-1, 0, 6, 999))).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        found, best = plain(encode, text, 6)
        assert list(r["counts"]) == found
        assert (r["p-1"], r.p0, r.p5, r.p999) == (None, 0, found[min(5, len(text))], found[-1])
        assert (r["b-1"], r.b0, r.b6, r.b999) == (None, 0, best[1], len(text))


def test_edges(spark, encode):
    texts = {1: "", 3: "word " * 30_000, 4: "x" * 20_000, 5: " " * 5000 + "\n", 6: "é中\x00\r\n <|endoftext|>", 7: "0" * 3000}
    rows = [(k, v, 9, "p") for k, v in texts.items()] + [(8, None, 9, "p"), (None, "a b", 9, "p"), (1, "a b", 9, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, counts string")
    got = [tuple(r) for r in T.counts(df).orderBy("doc_id", "n_bytes").collect()]
    want = [(k, len((t or "").encode()), encode(t or ""), encode(t or "") > 512) for k, t, *_ in rows]
    assert sorted((g[:4] for g in got), key=repr) == sorted(want, key=repr)
    assert T.counts(df.limit(0)).collect() == [] and T.stored(df.limit(0)).collect() == []


def test_other_kinds_of_vocabularies_are_refused(spark):
    with pytest.raises(ValueError):
        T.prefixes_of(T.vocabulary(spark, T.path("word_bpe_49k.json")))
