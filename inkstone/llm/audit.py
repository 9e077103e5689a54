"""Filter interaction audit: what every order of five filters removes, from one pass over the documents.

A document is the set of filters that it fails, so documents are counted by part and set
(32 at most), and those counts give the 80 edges (already applied subset, next filter) of
the subset lattice: who is kept, removed or redundant there depends on the subset alone,
not on the order inside it.  The 600 steps of all 120 orders are paths through the
lattice, so each step is joined to its edge.

Repeats need no group of equal texts: the smallest id of each text comes from a partial
minimum by digest, and meets the documents again by id and digest, so copies, however
many, are never one key.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import settle, table

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = r"[#$%&*|]"


def failed(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 1, 2, 4 and 8."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    rules = (
        n < 50,
        100 * F.size(F.array_distinct(words)) < 65 * n,
        100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 5 * F.length(text),
        text.rlike(MARKS),
    )
    return sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules)), F.lit(0))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits applied before, bit of the step's filter) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        bits = [1 << f for f in order]
        out += (("".join(FILTERS[f] for f in order), k + 1, sum(bits[:k]), bits[k]) for k in range(len(bits)))
    return out


def edges() -> list[tuple[int, int, int]]:
    """(bits applied before, bit of the next filter, orders that take this edge) of the lattice."""
    out = []
    for f in range(len(FILTERS)):
        others = [1 << k for k in range(len(FILTERS)) if k != f]
        out += ((sum(c), 1 << f, factorial(n) * factorial(len(others) - n)) for n in range(len(others) + 1) for c in combinations(others, n))
    return out


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) of every document; E is the bit 16: an equal text stands under a smaller id.

    A null text is empty, a null source the part ''.  Rows with a null id fail E never
    and have no labels; of rows with one id all or none fail E for a text; a label counts
    if any row of the id has it.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text, 256)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), digest.alias("digest"), failed(text).alias("failed"))
    rows = settle(rows)
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    named = rows.where("id is not null").join(known, "id", "left").join(firsts, ["id", "digest"], "left")
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    named = named.select("part", (F.col("failed") + F.when(F.col("first"), 0).otherwise(16)).alias("failed"), flag("good"), flag("toxic"))
    return named.unionByName(rows.where("id is null").select("part", "failed", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley), zeros included; edge cases as in marked(); an empty table gives
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    sets = marked(docs, labels).groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    every = F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(b).alias("next"), F.lit(w).alias("orders")) for a, b, w in edges()))
    met = sets.select("*", F.explode(every).alias("e")).select("part", "failed", "n", "good", "toxic", "e.*")
    fails, before = F.col("failed").bitwiseAND(F.col("next")) != 0, F.col("failed").bitwiseAND(F.col("applied")) != 0
    gone = fails & ~before
    total = lambda rule, c: F.sum(F.when(rule, F.col(c)).otherwise(0))
    lattice = met.groupBy("part", "applied", "next", "orders").agg(
        total(~fails & ~before, "n").alias("kept"), total(gone, "n").alias("removed"), total(fails & before, "n").alias("redundant"),
        total(gone, "good").alias("good_lost"), total(gone, "toxic").alias("toxic_lost"),
    )
    lattice = settle(lattice)
    # Behind all others a filter removes what fails it alone.
    behind = F.col("applied") + F.col("next") == (1 << len(FILTERS)) - 1
    whole = lattice.groupBy("part", "next").agg(total(behind, "removed").alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    path = spark.createDataFrame(steps(), "filter_order string, step int, applied int, next int")
    rows = lattice.join(whole, ["part", "next"]).join(F.broadcast(path), ["applied", "next"])
    return rows.select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Query: the five filters over all documents in all 120 orders, step by step, for each source.

    Null texts are empty texts, null sources the part ''; texts of any length count whole;
    repeated rows count each; an empty table gives an empty result.
    """
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    """Every document against every order and step, by the rules as they are worded."""
    words = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {{'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)}} AS f FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
s AS (SELECT part, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END, CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || e.x || g.x || h.x AS filter_order FROM c a JOIN c b ON b.x <> a.x JOIN c e ON e.x NOT IN (a.x, b.x) JOIN c g ON g.x NOT IN (a.x, b.x, e.x) JOIN c h ON h.x NOT IN (a.x, b.x, e.x, g.x)),
p AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS done FROM o, range(1, 6) r(step)),
j AS (SELECT s.*, p.*, contains(fails, x) AS bad, len(list_filter(string_split(done, ''), lambda y: y <> '' AND contains(fails, y))) > 0 AS gone FROM s, p),
k AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (bad AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails, coalesce(sum(n) FILTER (bad AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (bad AND NOT gone AND toxic), 0) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM k"""


OP13_SQL = _sql()
