"""Running values over a key's rows without holding the key in one task.

Rows are dealt by key and span, SPAN places each.  A window runs inside a span; a row for
each span sums it up, a window over those few rows tells what came before, and joins that.
Where no key is longer than a span, one window does: `whole` says so, else the largest
place is looked up, so rows should be a written table, or narrow.

tasks: to how many tasks rows are dealt, which `measured` tells; else they stay where they
lie, or go to the session's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from inkstone.operators.parse import SHARE

SPAN = 20_000
#: What a row takes besides its text, as characters of a task's share.
ROW = 100


def measured(rows: DataFrame, place: str = "block_seq", text: str = "content", span: int | None = None) -> tuple[bool, int]:
    """Whether no key has more than a span of rows, and to how many tasks rows are dealt: the session's number, and more for more text."""
    last, chars, n = rows.agg(F.max(place), F.sum(F.length(text)), F.count("*")).head()
    return (last or 0) < (span or SPAN), max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-((chars or 0) + ROW * n) // SHARE))


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """rows by their keys in so many tasks; as they are where no number is given.

    Of a join, dealing the smaller side is enough: the other one follows it.
    """
    return rows if tasks is None else rows.repartition(tasks, *keys)


def fits(rows: DataFrame, place: str, span: int | None = None, whole: bool | None = None) -> bool:
    """Whether no key has more than a span of rows."""
    return whole if whole is not None else (rows.agg(F.max(place)).head()[0] or 0) < (span or SPAN)


def _spans(rows: DataFrame, key: str, place: str, span: int | None, tasks: int | None) -> tuple[DataFrame, WindowSpec]:
    rows = rows.withColumn("_span", F.floor(F.col(place) / (span or SPAN)).cast("long"))
    return rows.repartition(*(() if tasks is None else (tasks,)), key, "_span"), Window.partitionBy(key, "_span").orderBy(place)


def sum_before(rows: DataFrame, key: str, place: str, name: str, value: Column, span: int | None = None, here: bool = False, whole: bool | None = None, tasks: int | None = None) -> DataFrame:
    """rows with `name`, the sum of value over the key's rows before each; here: with all of its place."""
    to = lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow) if here else w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda w: F.coalesce(F.sum("_value").over(to(w)), F.lit(0))
    one = fits(rows, place, span, whole)
    rows = rows.withColumn("_value", value)
    if one:
        return dealt(rows, tasks, key).withColumn(name, so_far(Window.partitionBy(key).orderBy(place))).drop("_value")
    rows, inside = _spans(rows, key, place, span, tasks)
    each = rows.groupBy(key, "_span").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(key, "_span", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return rows.withColumn("_own", so_far(inside)).join(each, [key, "_span"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_value", "_own", "_before", "_span")


def seen(rows: DataFrame, key: str, place: str, last: dict[str, Column] | None = None, first: dict[str, Column] | None = None, span: int | None = None, whole: bool | None = None, tasks: int | None = None) -> DataFrame:
    """rows with the last, or the first, value that is not null among the key's rows up to each."""
    wanted = [(n, v, F.last, F.max_by) for n, v in (last or {}).items()] + [(n, v, F.first, F.min_by) for n, v in (first or {}).items()]
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if fits(rows, place, span, whole):
        order = so_far(Window.partitionBy(key).orderBy(place))
        return dealt(rows, tasks, key).withColumns({n: pick(v, ignorenulls=True).over(order) for n, v, pick, _ in wanted})
    rows, inside = _spans(rows.withColumns({f"_v_{n}": v for n, v, *_ in wanted}), key, place, span, tasks)
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(key, "_span").agg(*(by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(place))).alias(f"_v_{n}") for n, _, _, by in wanted))
    each = each.select(key, "_span", *(pick(f"_v_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n, _, pick, _ in wanted))
    rows = rows.withColumns({f"_v_{n}": pick(f"_v_{n}", ignorenulls=True).over(so_far(inside)) for n, _, pick, _ in wanted}).join(each, [key, "_span"])
    out = {n: F.coalesce(*((f"_v_{n}", f"_b_{n}") if pick is F.last else (f"_b_{n}", f"_v_{n}"))) for n, _, pick, _ in wanted}
    return rows.withColumns(out).drop("_span", *(f"_{x}_{n}" for n, *_ in wanted for x in "vb"))
