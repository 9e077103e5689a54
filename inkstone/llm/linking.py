"""Links inside groups of any size, without a task or a row count that grows with a group's square.

A group's members are dealt into blocks.  Round one compares each block with itself
and with the group's first block, and joins what it links into components.  Round two
takes the members outside the group's most common component and compares them with
every block.  Two members that were never compared are then in one component already,
so the components are those of all links, at a cost in proportion to the group unless
it falls into many large components.  A task sees at most two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import components, settle

EDGES = "src long, dst long"


class Forest:
    """Union-find over 0..n-1; a root is the smallest of its set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while not np.array_equal(nxt := self.up[self.up], self.up):
            self.up = nxt
        return self.up


def span(n: int, near: Callable[[int], np.ndarray], fresh: np.ndarray | None, old: np.ndarray | None) -> np.ndarray:
    """(member, smallest member of its component) over the links that near(i) finds from i to later rows."""
    trees = Forest(n)
    if old is not None:
        _, first, which = np.unique(old, return_index=True, return_inverse=True)
        trees.up = np.minimum(np.arange(n), first[which])
    before = trees.roots().copy()
    for i in range(n - 1):
        hits = near(i)
        if fresh is not None and not fresh[i]:
            hits = hits[fresh[hits]]
        if len(hits):
            for j in hits[trees.up[hits] != trees.root(i)].tolist():
                trees.join(i, j)
    after = trees.roots()
    new = np.flatnonzero(after != before)
    return np.stack([new, after[new]], 1)


def over_groups(keys: list[str], prepare: Callable, edges_of: Callable, rounds: int):
    """A mapInArrow function: edges_of on each key's rows; the partition's rows come sorted by keys."""

    def run(batches):
        tail: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is None:
                if tail is None:
                    return
                rows = tail
            elif not batch.num_rows:
                continue
            else:
                rows = pa.Table.from_batches([batch])
                rows = rows if tail is None else pa.concat_tables([tail, rows])
            change = np.zeros(rows.num_rows, bool)
            for k in keys:
                col = rows[k].to_numpy()
                change[1:] |= col[1:] != col[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), rows.num_rows]
            if batch is not None:
                tail = rows.slice(cuts[-2])
                cuts = cuts[:-1]
            if len(cuts) < 2:
                continue
            ids, cols = rows["id"].to_numpy(), prepare(rows)
            fresh = rows["_fresh"].to_numpy(zero_copy_only=False) if rounds > 1 else None
            old = rows["_c"].to_numpy() if rounds > 1 else None
            found = [lo + e for lo, hi in zip(cuts, cuts[1:]) if hi - lo > 1 and len(e := edges_of(cols, lo, hi, None if fresh is None else fresh[lo:hi], None if old is None else old[lo:hi]))]
            if found:
                pairs = ids[np.concatenate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["src", "dst"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def link(members: DataFrame, group: str, payload: DataFrame, prepare: Callable, edges_of: Callable, block: int) -> DataFrame:
    """Components over the links inside groups: (id, component), for linked ids only.

    members: the group's column (a long), id and weight; payload: id and what is compared.
    prepare makes arrays of a table; edges_of(arrays, lo, hi, fresh, old) returns index
    pairs, relative to lo, that span the links among those rows (see span).  block is
    the weight of a block.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("_n"), F.ceil(F.sum("weight") / block).cast("long").alias("_blocks")).where("_n > 1").drop("_n")
    dealt = members.join(sizes, group).drop("weight").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    dealt = settle(dealt.join(payload, "id"))

    def linked(df: DataFrame, keys: list[str], rounds: int) -> DataFrame:
        run = over_groups(keys, prepare, edges_of, rounds)
        return df.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, EDGES)

    # Block 0 also goes to each of the other blocks of its group.
    to = F.when(F.col("_block") == 0, F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).otherwise(F.array("_block"))
    star = settle(linked(dealt.withColumn("_to", F.explode(to)).drop("_block", "_blocks"), [group, "_to"], 1).distinct())
    label = components(star)
    hot = dealt.where("_blocks > 1")
    if hot.isEmpty():
        return label
    hot = hot.join(label, "id", "left").withColumn("_c", F.coalesce("component", "id")).drop("component")
    most = hot.groupBy(group, "_c").agg(F.count("*").alias("_k")).groupBy(group).agg(F.max_by("_c", F.struct("_k", "_c")).alias("_most"), F.count("*").alias("_cs")).where("_cs > 1")
    hot = settle(hot.join(most, group).withColumn("_fresh", F.col("_c") != F.col("_most")).drop("_most", "_cs"))
    # The rest of a group, in parts of a block's size, meets every block, and each part each other part.
    fresh = hot.where("_fresh")
    parts = fresh.groupBy(group).agg(F.count("*").alias("_k")).join(sizes, group)
    every = hot.groupBy(group).agg(F.count("*").alias("_all"))
    parts = parts.join(every, group).select(group, F.ceil(F.col("_k") * F.col("_blocks") / F.col("_all")).cast("long").alias("_parts"))
    each = F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)
    rest = hot.where("not _fresh").join(parts, group).withColumn("_from", F.explode(each)).withColumn("_to", F.col("_block"))
    fresh = fresh.join(parts, group).withColumn("_mine", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_parts")))
    new = fresh.withColumn("_from", F.col("_mine")).withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    cross = fresh.withColumn("_x", F.explode(each)).where("_x != _mine").withColumn("_from", F.least("_x", "_mine")).withColumn("_to", -1 - F.greatest("_x", "_mine")).drop("_x")
    drop = ["_block", "_blocks", "_parts", "_mine"]
    both = rest.drop(*drop).unionByName(new.drop(*drop)).unionByName(cross.drop(*drop))
    return components(star.unionByName(linked(both, [group, "_from", "_to"], 2)))
