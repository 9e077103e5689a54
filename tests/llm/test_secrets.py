import hashlib
import random
import re

from inkstone.llm import secrets

SF = "/root/testdata/sf0.01"
KINDS = [
    (re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base(text):
    return sorted((m.start(), k, m.end()) for k, (rx, ok) in enumerate(KINDS) for m in rx.finditer(text or "") if ok(m))


def digest(spans):
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    for r, (_, text) in zip(sorted(secrets.scan(df).collect(), key=lambda r: r.id), rows):
        spans = base(text)
        assert (r.base_sha256, r.n_assign, r.n_access, r.n_hex) == (digest(spans), *(sum(k == n for _, k, _ in spans) for n in range(3))), text


def test_query_matches_plain_expressions(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = secrets.op5_secret_scan(spark, SF).collect()
    assert len(found) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in found) > 10
    assert all(r.base_sha256 == digest(base(texts[r.doc_id])) for r in found)


def test_random_texts(spark):
    rng = random.Random(2)
    parts = ["password", "PassWord", "token", "secret", "api_key", "APIKEY", "passwd", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "=", ":", " ", '"', "'", "abc123", "deadbeef01", "0123456789abcdef01234567", "é", "\n", "İ", "ſecret", "K", "x"]
    check(spark, [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(1500)])


def test_edges(spark):
    check(spark, [(0, None), (1, ""), (2, "é" * 9 + "token=abcdefg"), (3, "token=abc token=abcdef"), (4, "tokenpassword: 'xyzxyz'"), (5, "a" * 24), (6, "z" + "0" * 23 + "z"), (7, "word " * 200_000 + "secret = abcdef")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scan(empty).collect() == []


def test_checksums(spark):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good, bad = f"ghp_{body}{secrets.checksum(body)}", f"ghp_{body}AAAAAA"
    df = spark.createDataFrame([(1, f"use {good} now"), (2, bad), (3, f"npm_{body}{secrets.checksum(body)}")], "doc_id long, text string")
    assert [r.spans for r in secrets.scan(df).orderBy("id").collect()] == ["forge:4:44", "", "registry:0:40"]
    assert [r.text for r in secrets.redact(df).orderBy("doc_id").collect()] == ["use [forge] now", bad, "[registry]"]


def test_redact_edges(spark):
    """Nulls stay null, overlapping spans go as one, an empty table stays empty; other columns come through."""
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "token=" + "0" * 30, "c"), (4, "word " * 100_000 + "AKIA" + "B" * 20, "d")], "doc_id long, text string, spans string")
    rows = secrets.redact(df).orderBy("doc_id").collect()
    assert [r.text for r in rows[:3]] == [None, "", "[assign]"] and rows[3].text == "word " * 100_000 + "[access]" and [r.spans for r in rows] == list("abcd")
    empty = secrets.redact(df.limit(0))
    assert empty.columns == df.columns and empty.collect() == []
