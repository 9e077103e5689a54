import numpy as np
import pytest

from inkstone.llm import embeddings


def brute(rows, cosine=0.93):
    ids = [r[0] for r in rows]
    links, up = {i: 0 for i in ids}, {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sound = [(i, np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for a, (i, v, lab) in enumerate(sound):
        for j, w, other in sound[a + 1 :]:
            if lab == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i in ids}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # many blocks
    rng = np.random.default_rng(3)
    rows = []
    for group in range(12):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 60)):
            rows.append((len(rows), [float(x) for x in np.float32(centre + rng.normal(size=24) * rng.choice([0, 0.1, 0.25, 0.5]))], int(group % 3)))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [None] * 24, 1), (2004, rows[0][1], None), (2005, rows[0][1][:23], rows[0][2]), (2006, [], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, id int, copies int").repartition(4)
    out = embeddings.near_vectors(df).collect()
    assert {r.id: (r.n_links, r.component) for r in out} == brute(rows)
    wide = embeddings.near_vectors(df.withColumn("embedding", df["embedding"].cast("array<double>")), cosine=0.99).collect()
    assert {r.id: (r.n_links, r.component) for r in wide} == brute(rows, 0.99)
    assert all(r.kept == (r.id == r.component) for r in out)


def test_recall_at_the_threshold():
    """Pairs exactly at the threshold share a code in some table almost always."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    bits, tables = embeddings.plan(50_000, 0.93)
    met = (embeddings._codes(a, bits, tables) == embeddings._codes(c, bits, tables)).any(1)
    assert met.mean() > 0.99


@pytest.mark.parametrize("n", [0, 1, 10**9])
def test_plan(n):
    bits, tables = embeddings.plan(n, 0.93)
    assert 12 <= bits <= 30 and 20 < tables < 500


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(df).collect() == []
