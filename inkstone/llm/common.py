"""What the operators of this subpackage share: tables, folds, stage files, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.sources.stage import settle, shared_dir  # noqa: F401  what a stage writes, for all operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's readers open the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def free(taken: list[str], name: str) -> str:
    """A name for a column of one's own, like none of taken; Spark's names know no case."""
    used = {c.lower() for c in taken}
    name = f"_{name}"
    while name in used:
        name = f"_{name}"
    return name


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected graph: (id, component), component the smallest id reachable.

    Contraction: each round every vertex takes its smallest neighbour (or itself) as
    parent, parents are followed twice, and the edges move to the parents.  A round
    at least halves each component's vertices, and stars vanish in one.  Only vertices
    with an edge are returned; empty edges give an empty result.  Nothing is collected.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a != b")
    live = settle(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not live.isEmpty():
        each = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = settle(each.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = settle(parent.join(up, "p").select("a", F.col("q").alias("p")))
        if label is None:
            label = parent.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            up = parent.select(F.col("a").alias("component"), "p")
            label = label.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        label = settle(label)
        a, b = (parent.select(F.col("a").alias(x), F.col("p").alias(f"{x}p")) for x in "ab")
        moved = live.join(a, "a").join(b, "b").where("ap != bp").select(F.least("ap", "bp").alias("a"), F.greatest("ap", "bp").alias("b"))
        live = settle(moved.distinct())
    if label is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return label
