import random
import re
from itertools import permutations

from inkstone.llm import audit as A

DOC, LABEL = "doc_id long, text string, source string, failed int, part string", "doc_id long, quality int, toxic int"


def fails(doc, docs):
    text = doc[1] or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
    return set(out + "E" * any(o[0] is not None and doc[0] is not None and o[0] < doc[0] and (o[1] or "") == text for o in docs))


def plain(docs, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    failed = [fails(d, docs) for d in docs]
    out = []
    for part in {d[2] or "" for d in docs}:
        own = [(d, f) for d, f in zip(docs, failed) if (d[2] or "") == part]
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                total[x] += len(gone)
                rows.append((x, part, order, step, len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(d[0] in good for d, _ in gone), sum(d[0] in toxic for d, _ in gone)))
        out += [(*r[1:], total[r[0]]) for r in rows]
    return sorted(out)


def test_against_every_order_walked(spark):
    rng = random.Random(13)
    words = ["a", "b", "Ccc", "d#", "é", "中文", "word"] + [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 20, 97])]) for _ in range(rng.choice([0, 3, 49, 50, 51, 80]))) for _ in range(40)] + ["", None, "\x0b \t", "X" * 70_000, "a " * 60_000]
    docs = [(rng.choice([None, i, i, i, 3]), rng.choice(texts), rng.choice(["s", "t", "", None]), 1, "x") for i in range(150)]
    labels = [(rng.choice([None, *range(150)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(120)]
    rows = A.audit(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)).collect()
    assert sorted(tuple(r) for r in rows) == plain(docs, labels)


def test_lattice():
    assert len(A.edges()) == 80 and sum(w for *_, w in A.edges()) == 600 == len(A.steps())
    assert {s[2:] for s in A.steps()} == {e[:2] for e in A.edges()}


def test_empty_and_unlabelled(spark):
    docs, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)
    assert A.audit(docs, labels).collect() == []
    rows = A.audit(spark.createDataFrame([(1, "x", None, 0, "")], DOC), labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.good_lost + r.toxic_lost for r in rows) == 0
