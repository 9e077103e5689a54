"""Late session merging: every version of a user's sessions as batches of late events come in.

Union-find per user: a batch's events become active and are united with the active
predecessor and successor within the gap; roots carry extents, counts, sums and the
standing version, which the session's next version retracts.

A user's work is dealt in blocks of batches, since a batch's events lie near it in time:
at most `reach` batches away, which is measured.  A chunk of time is at least as long as
that reach and the gap, so what block k makes active lies in chunks k - 1 to k + 1, and
all before chunk k - 1 is active by then and will not change.  Of that, only the session
that ends last can grow, and it enters the block's forest as one element, with its extent,
count, sum and standing version; a segmented scan over the chunks' sums gives it.  So a
task holds three chunks of one user, where the events of one second and batch are one
element, however many events or chunks the user has.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import settle, table

GAP, PERIOD = 600, 900
#: Batches of a block, at least; a chunk is as long. Chunks that one task of the scan holds.
BLOCK, SPAN = 16, 256

VERSION = "user long, batch long, start_s long, end_s long, n_events long, n_new long, n_retracted long, h_sum long, retracted_batch long, retracted_start_s long"


class Session:
    """What the root of a tree carries; standing: the versions that its next version retracts."""

    __slots__ = ("start", "end", "n", "h", "latest", "new", "standing")

    def __init__(self, start: int, end: int, n: int, h: int, latest: int, new: int = 0):
        self.start, self.end, self.n, self.h, self.latest, self.new = start, end, n, h, latest, new
        self.standing: list[tuple[int, int]] = []

    def absorb(self, other: Session) -> None:
        self.start, self.end, self.latest = min(self.start, other.start), max(self.end, other.end), max(self.latest, other.latest)
        self.n, self.h, self.new = self.n + other.n, self.h + other.h, self.new + other.new
        self.standing += other.standing


class Forest:
    """One user's elements (start, end, batch, n, h) in order of time; the active ones stand in trees, a tree for each session."""

    def __init__(self, elements: list[tuple], gap: int):
        self.elements, self.gap = elements, gap
        self.parent: dict[int, int] = {}
        self.sessions: dict[int, Session] = {}
        self.active: list[int] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def unite(self, i: int, k: int) -> None:
        i, k = self.root(i), self.root(k)
        if i != k:
            if self.sessions[i].n < self.sessions[k].n:
                i, k = k, i
            self.parent[k] = i
            self.sessions[i].absorb(self.sessions.pop(k))

    def activate(self, members: list[int], fresh: bool) -> list[Session]:
        """Make elements active and unite them with their neighbours; the sessions that hold any of them then."""
        for i in members:
            start, end, batch, n, h = self.elements[i]
            self.parent[i], self.sessions[i] = i, Session(start, end, n, h, batch, n if fresh else 0)
        own = set(members)
        self.active = sorted(self.active + members)
        for i, k in zip(self.active, self.active[1:]):
            if (i in own or k in own) and self.elements[k][0] - self.elements[i][1] <= self.gap:
                self.unite(i, k)
        return [self.sessions[r] for r in {self.root(i) for i in members}]


def _versions(elements: list[tuple], first: int, gap: int):
    """(batch, start, end, n, new, retracted, h, None, None) of every version from batch `first` on, and (batch, start, ..., by batch, by start) of every version that one of them retracts."""
    forest = Forest(elements, gap)
    for own in forest.activate([i for i, e in enumerate(elements) if e[2] < first], False):
        own.standing = [(own.latest, own.start)]
    late = sorted((i for i, e in enumerate(elements) if e[2] >= first), key=lambda i: elements[i][2])
    for batch, members in groupby(late, key=lambda i: elements[i][2]):
        for own in forest.activate(list(members), True):
            yield (batch, own.start, own.end, own.n, own.new, len(own.standing), own.h, None, None)
            for old in own.standing:
                yield (*old, None, None, None, None, None, batch, own.start)
            own.standing, own.new = [(batch, own.start)], 0


def versions(events: DataFrame, gap: int = GAP, period: int = PERIOD, block: int = BLOCK) -> DataFrame:
    """Every version of the sessions of events (user, seconds, batch, value), whole numbers, batches of `period` seconds.

    (user, batch, start_s, end_s, n_events, n_new, n_retracted, h_sum: the sum of values,
    retracted_batch, retracted_start_s: the version that retracts it, null for a final one).
    Events of a user at most `gap` seconds apart share a session.  Rows with a null user,
    time or batch are no events; a null value adds nothing; repeated rows are events of
    their own; an empty table gives an empty result; other columns are not read.  Events
    that come very late only make the blocks longer.
    """
    cells = events.select(*(F.col(c).cast("long").alias(c) for c in ("user", "seconds", "batch", "value"))).dropna(subset=["user", "seconds", "batch"])
    cells = settle(cells.groupBy("user", "seconds", "batch").agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("h")))
    reach = cells.agg(F.max(F.abs(F.col("batch") - floor_div(F.col("seconds"), period)))).head()[0] or 0
    length = max(block, reach, -(-gap // period))
    cells = cells.withColumns({"chunk": floor_div(F.col("seconds"), length * period), "own": floor_div(F.col("batch"), length)})
    elements = cells.select("user", F.explode(F.sequence("own", F.col("chunk") + 1)).alias("block"), F.col("seconds").alias("start"), F.col("seconds").alias("end"), "batch", "n", "h")
    before = _last_sessions(cells, gap).where(F.col("end") >= (F.col("chunk") + 1) * (length * period) - gap)
    elements = elements.unionByName(before.select("user", (F.col("chunk") + 2).alias("block"), "start", "end", F.col("latest").alias("batch"), "n", "h"))
    dealt = elements.repartition("user", "block").sortWithinPartitions("user", "block", "end", "batch")
    names = [c.split()[0] for c in VERSION.split(", ")]

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for (user, k), own in groupby(rows, key=lambda r: r[:2]):
            out += ((user, *v) for v in _versions([r[2:] for r in own], k * length, gap))
            if len(out) >= 10_000:
                yield _batch(out, names)
                out = []
        if out:
            yield _batch(out, names)

    found = dealt.select("user", "block", "start", "end", "batch", "n", "h").mapInArrow(run, VERSION)
    # A version and what retracts it can come from two blocks.
    return found.groupBy("user", "batch", "start_s").agg(*(F.max(c).alias(c) for c in names[3:])).select(*names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def floor_div(x: Column, n: int) -> Column:
    """x / n in whole numbers, rounded down; n > 0."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def _last_sessions(cells: DataFrame, gap: int) -> DataFrame:
    """(user, chunk, start, end, n, h, latest): of each chunk's last session all that lies in it and the chunks before, once all events are there."""
    inside = Window.partitionBy("user", "chunk")
    cut = F.when(F.col("seconds") - F.lag("seconds").over(inside.orderBy("seconds", "batch")) > gap, F.col("seconds"))
    rows = cells.withColumn("cut", cut).withColumn("tail", F.max("cut").over(inside))
    last = F.coalesce(F.col("seconds") >= F.col("tail"), F.lit(True))
    rows = rows.groupBy("user", "chunk").agg(
        F.min("seconds").alias("first"), F.max("seconds").alias("end"), F.max("tail").alias("tail"),
        F.sum(F.when(last, F.col("n"))).alias("n"), F.sum(F.when(last, F.col("h"))).alias("h"), F.max(F.when(last, F.col("batch"))).alias("latest"),
    )
    rows = settle(rows)
    near = rows.select("user", (F.col("chunk") + 1).alias("chunk"), F.col("end").alias("_end"))
    rows = rows.join(near, ["user", "chunk"], "left")
    fresh = F.col("tail").isNotNull() | F.coalesce(F.col("first") - F.col("_end") > gap, F.lit(True))
    rows = rows.select("user", "chunk", F.coalesce("tail", "first").alias("start"), "end", "n", "h", "latest", fresh.alias("fresh"), floor_div(F.col("chunk"), SPAN).alias("part"))
    # A scan inside parts of SPAN chunks, then one over the parts' ends.
    own = settle(_scan(rows, "chunk", "user", "part"))
    state = ("start", "n", "h", "latest")
    ends = own.groupBy("user", "part").agg(F.max_by(F.struct(*state, (F.col("segment") > 0).alias("fresh")), "chunk").alias("s")).select("user", "part", "s.*")
    carried = _scan(ends, "part", "user").select("user", (F.col("part") + 1).alias("part"), F.struct(*state).alias("c"))
    open_ = (F.col("segment") == 0) & F.col("c").isNotNull()
    joined = own.join(carried, ["user", "part"], "left")
    return joined.select(
        "user", "chunk", F.when(open_, F.col("c.start")).otherwise(F.col("start")).alias("start"), "end",
        *((F.col(c) + F.when(open_, F.col(f"c.{c}")).otherwise(0)).alias(c) for c in ("n", "h")),
        F.when(open_, F.greatest("c.latest", "latest")).otherwise(F.col("latest")).alias("latest"),
    )


def _scan(rows: DataFrame, place: str, *by: str) -> DataFrame:
    """rows with segment, the number of fresh rows so far, and start, n, h and latest of the segment so far."""
    rows = rows.withColumn("segment", F.sum(F.col("fresh").cast("int")).over(Window.partitionBy(*by).orderBy(place)))
    so_far = Window.partitionBy(*by, "segment").orderBy(place)
    return rows.withColumns({"start": F.first("start").over(so_far), "n": F.sum("n").over(so_far), "h": F.sum("h").over(so_far), "latest": F.max("latest").over(so_far)})


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Turns as events (user, seconds, batch, value); rows without a turn or conversation are none."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    crc = lambda *parts: F.crc32(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))
    rows = conversations.select(conv.alias("conv"), turn.alias("turn"), crc(conv).alias("c"), crc(conv, turn).alias("h")).dropna(subset=["conv", "turn"])
    seconds = F.pmod(floor_div(F.col("c"), 2), F.lit(7200)) + 300 * F.col("turn") + F.col("h") % 600
    late = floor_div(F.col("h"), 600)
    rows = rows.select((2 * floor_div(F.col("conv"), 8) + F.col("c") % 2).alias("user"), seconds.alias("seconds"), F.when(late % 5 == 0, late % 4).otherwise(0).alias("late"), F.col("h").alias("value"))
    return rows.select("user", "seconds", (floor_div(F.col("seconds"), PERIOD) + F.col("late")).alias("batch"), "value")


def op12_session_merging(spark, sf_dir: str) -> DataFrame:
    """Query: every version of the sessions that turns of conversations form, in batches of 900 seconds with late events.

    Rows with a null turn or conversation are no events; texts are not read; repeated rows
    count each; an empty table gives an empty result.
    """
    return versions(conversation_events(table(spark, sf_dir, "conversations")))


def _crc_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT)),
  lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)::BIGINT[]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""


#: Sessions anew for every user and batch; a version is retracted by the first later one that contains it.
OP12_SQL = f"""WITH k AS (SELECT conv_id, turn, {_crc_sql("conv_id::VARCHAR")} AS c, {_crc_sql("(conv_id::VARCHAR || ':' || turn::VARCHAR)")} AS h FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
t AS (SELECT 2 * floor(conv_id / 8)::BIGINT + c % 2 AS usr, c // 2 % 7200 + 300 * turn + h % 600 AS s, h, h // 600 AS g FROM k),
ev AS (SELECT usr, s, h, floor(s / 900)::BIGINT + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS batch FROM t),
act AS (SELECT b.usr, b.batch AS b, e.batch, s, h FROM (SELECT DISTINCT usr, batch FROM ev) b JOIN ev e ON e.usr = b.usr AND e.batch <= b.batch),
cut AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY usr, b ORDER BY s) <= 600 THEN 0 ELSE 1 END AS opens FROM act),
num AS (SELECT *, sum(opens) OVER (PARTITION BY usr, b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM cut),
v AS (SELECT usr, b AS batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (batch = b) AS n_new, sum(h) AS h_sum FROM num GROUP BY usr, b, session HAVING count(*) FILTER (batch = b) > 0),
r AS (SELECT u.usr, u.batch, u.start_s, w.batch AS by_batch, w.start_s AS by_start FROM v u JOIN v w ON w.usr = u.usr AND w.batch > u.batch AND w.start_s <= u.start_s AND w.end_s >= u.end_s
  QUALIFY row_number() OVER (PARTITION BY u.usr, u.batch, u.start_s ORDER BY w.batch) = 1)
SELECT v.usr AS "user", v.batch, v.start_s, end_s, n_events, n_new, (SELECT count(*) FROM r x WHERE x.usr = v.usr AND x.by_batch = v.batch AND x.by_start = v.start_s) AS n_retracted, h_sum::BIGINT AS h_sum,
  r.by_batch AS retracted_batch, r.by_start AS retracted_start_s FROM v LEFT JOIN r ON r.usr = v.usr AND r.batch = v.batch AND r.start_s = v.start_s"""
