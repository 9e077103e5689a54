"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed over cells of source, language and topic.  Raking multiplies the weight
of each cell by target / current total of its source, then of its language, then of its
topic, over and over until every marginal is within TOLERANCE of its target; the deviation
that remains after ROUNDS rounds is returned with the weights.  A document's probability is
its cell's weight divided by the largest one, so the tokens expected of the sample have the
target marginals; a hash of the id decides, alike in every run.

Where that would expect less than SHARE of the wanted tokens, because a small cell has a
large weight, the scale is set by SHARE instead, or by a budget of tokens where one is
given.  A value that has fewer tokens than its target is wanted whole and the other values
of its dimension share the rest in their proportions; raking goes on with probabilities of
at most 1, so that cells that reach 1 are kept whole and the others make up for them.

For tables without topics they are hashed word clusters: the shares of a text's words with
each of two hash bits, compared with those of all words of its language, a centre that is
learned from all documents; texts that prefer the same words fall on the same sides.

Cells are a table like any other and are never collected.  They are counted: up to
BROADCAST rows they are raked in one task and broadcast to the documents, beyond that
marginals are partial sums joined back, and the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import free, settle, table

DIMENSIONS = ("source", "lang", "topic")
#: Without given targets, a value's target is its share of the tokens to this power, scaled to a sum of 1.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.8}
TOLERANCE, ROUNDS, STRIDE = 1e-6, 60, 5
#: Rounds end when STRIDE of them leave more than this part of the deviation: targets that contradict each other come no closer.
STALLED = 0.999
BROADCAST = 100_000
#: The least part of the wanted tokens that a sample is expected to have.
SHARE = 0.25
#: Factors of cells that are kept whole may grow without end; they are cut here.
FULL = 1e9
NONE = "(none)"


def n_tokens(text: str) -> Column:
    """Words between white space; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def features(text: str) -> Column:
    """Struct of tokens and of the tokens with each of the two hash bits."""
    hashes = F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w).bitwiseAND(3))
    # The array of one element binds the hashes, which are computed once.
    size = lambda h, bit: F.size(F.filter(h, lambda x: x.bitwiseAND(bit) != 0)).cast("long")
    return F.transform(F.array(hashes), lambda h: F.struct(F.size(h).cast("long").alias("tokens"), size(h, 1).alias("one"), size(h, 2).alias("two")))[0]


def topic_of(features: Column, centre: Column) -> Column:
    """t0 to t3: on which side of its language's shares a text lies; t0 without words."""
    side = lambda bit: F.when(F.try_divide(features[bit], features["tokens"]) > centre[bit], 1).otherwise(0)
    return F.when(features["tokens"] > 0, F.concat(F.lit("t"), (side("one") + 2 * side("two")).cast("string"))).otherwise("t0")


def bounded(df: DataFrame) -> DataFrame:
    """df, written, broadcast where it has at most BROADCAST rows."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= BROADCAST else df


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells with the weight that gives the weighted tokens the target marginals, scaled to the corpus's tokens, and the deviation that is left.

    targets: by dimension, the share of each value (scaled to a sum of 1 over the values
    that occur; values left out get none, and where none is wanted all weights are 0).
    Targets that no weights meet, because too many cells are empty, are met as closely as
    rounds bring them; deviation is then above TOLERANCE.  Only single sums and the
    largest deviation reach the driver.
    """
    total = float(cells.agg(F.sum("tokens")).head()[0] or 0)
    sums = {}
    for d in DIMENSIONS:
        each = cells.groupBy(d).agg((F.sum("tokens") / total).alias("share"))
        given = (targets or {}).get(d)
        if given is None:
            want = F.pow("share", F.lit(FLATTEN[d]))
        else:
            want = F.lit(0.0)
            for value, share in sorted(given.items()):
                want = F.when(F.col(d) == value, float(share)).otherwise(want)
        each = each.select(d, want.alias("want"))
        wanted = each.agg(F.sum("want")).head()[0] or 1.0
        sums[d] = each.select(d, (F.col("want") * total / wanted).alias(f"_{d}"))
    state = cells.withColumn("weight", F.lit(1.0))
    for d in DIMENSIONS:
        state = state.join(sums[d], d)
    state, off = fitted(state, F.col("weight"))
    return state.select(*DIMENSIONS, "tokens", "weight", F.lit(off).alias("deviation"))


def fitted(state: DataFrame, part: Column, most: float = float("inf")) -> tuple[DataFrame, float]:
    """state with the weight, at most `most`, whose part, times tokens, has the marginals _source, _lang and _topic; and their largest deviation."""
    state = settle(state)
    small = state.count() <= BROADCAST
    if small:
        state = state.coalesce(1)
    worst = float("inf")
    for _ in range(0, ROUNDS, STRIDE):
        for _ in range(STRIDE):
            for d in DIMENSIONS:
                scaled = lambda now, d=d: F.when(now > 0, F.least(F.col("weight") * F.col(f"_{d}") / now, F.lit(most))).otherwise(0.0)
                if small:
                    state = state.withColumn("weight", scaled(F.sum(F.col("tokens") * part).over(Window.partitionBy(d))))
                else:
                    now = state.groupBy(d).agg(F.sum(F.col("tokens") * part).alias("_now"))
                    state = settle(state.join(now, d).withColumn("weight", scaled(F.col("_now"))).drop("_now"))
        if small:
            state = settle(state).coalesce(1)
        off = []
        for d in DIMENSIONS:
            now = state.groupBy(d).agg(F.sum(F.col("tokens") * part).alias("now"), F.first(f"_{d}").alias("want")).where("want > 0")
            off.append(now.agg(F.max(F.abs(F.col("now") / F.col("want") - 1)).alias("off")))
        before, worst = worst, off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max("off")).head()[0] or 0.0
        if worst < TOLERANCE or worst > STALLED * before:
            break
    return state, worst


def filled(each: DataFrame, budget: float) -> float:
    """The factor of want at which the sum of the smaller of have and factor * want is budget; each: (have, want) of every value."""
    factor, n = 0.0, -1
    while True:
        full = F.col("have") <= F.col("want") * factor
        have, want, now = each.agg(F.sum(F.when(full, F.col("have"))), F.sum(F.when(~full, F.col("want"))), F.count(F.when(full, 1))).head()
        if now == n or not want:
            return factor
        factor, n = max(factor, (budget - (have or 0)) / want), now


def probabilities(raked: DataFrame, share: float = SHARE, budget: int | None = None) -> DataFrame:
    """raked cells with their probability: that of the weights alone, at share of the wanted tokens if that is more, or at a budget of tokens."""
    wanted = raked.where("weight > 0")
    most, tokens, sums = wanted.agg(F.max("weight"), F.sum("tokens"), F.sum(F.col("tokens") * F.col("weight"))).head()
    if not most or budget is None and sums / most >= share * tokens:
        return raked.withColumn("probability", F.col("weight") / (most or 1.0))
    budget = min(1.0, share) * tokens if budget is None else min(float(tokens), float(budget))
    state = wanted.withColumnRenamed("weight", "_raked").withColumn("weight", F.col("_raked") * budget / sums).drop("deviation")
    for d in DIMENSIONS:
        each = settle(wanted.groupBy(d).agg(F.sum("tokens").alias("have"), F.sum(F.col("tokens") * F.col("weight")).alias("want")))
        state = state.join(each.select(d, F.least("have", F.col("want") * filled(each, budget)).alias(f"_{d}")), d)
    state, off = fitted(state, F.least("weight", F.lit(1.0)), FULL)
    chance = F.when(F.col("weight") < 1 - 10 * TOLERANCE, F.col("weight")).otherwise(1.0)
    cells = state.select(*DIMENSIONS, "tokens", F.col("_raked").alias("weight"), F.lit(off).alias("deviation"), chance.alias("probability"))
    return cells.unionByName(raked.where("weight <= 0").withColumn("probability", F.lit(0.0)))


def decided(docs: DataFrame, targets, doc_id: str, text: str, dims: dict[str, Column] | None, seed: int, share: float, budget: int | None) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of source, lang, topic, tokens, weight, probability, deviation and kept; and its name."""
    name, own, cell, centre = (free(docs.columns, x) for x in ("mix", "own", "cell", "centre"))
    given = dims or {"source": F.col("source"), "lang": F.col("lang")}
    fields = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(d) for d, c in given.items()]
    rows = docs.withColumn(own, F.struct(*fields, (F.struct(n_tokens(text).alias("tokens")) if dims else features(text)).alias("f")))
    topic = F.col(own)["topic"] if dims else topic_of(F.col(own)["f"], F.col(centre))
    if not dims:
        seen = settle(rows.select(F.col(own).alias("own")))
        rate = lambda bit: F.try_divide(F.sum(f"own.f.{bit}"), F.sum("own.f.tokens")).alias(bit)
        centres = seen.groupBy(F.col("own.lang").alias("lang")).agg(F.struct(rate("one"), rate("two")).alias("centre"))
        centres = bounded(centres.select(F.struct("lang", "centre.one", "centre.two").alias(centre)))
        met = lambda df, at: df.join(centres, at["lang"] == F.col(centre)["lang"], "left")
        rows = met(rows, F.col(own))
        cells = met(seen.select(F.col("own").alias(own)), F.col(own))
    else:
        cells = rows.select(own)
    at = lambda topic: [F.col(own)["source"].alias("source"), F.col(own)["lang"].alias("lang"), topic.alias("topic")]
    cells = cells.select(*at(topic), F.col(own)["f"]["tokens"].alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    raked = probabilities(settle(rake(settle(cells), targets)), share, budget)
    raked = bounded(raked.select(F.struct(*DIMENSIONS, "weight", "probability", "deviation").alias(cell)))
    rows = rows.withColumn(own, F.struct(*at(topic), F.col(own)["f"]["tokens"].alias("tokens")))
    out = rows.join(raked, [F.col(own)[d] == F.col(cell)[d] for d in DIMENSIONS], "left")
    value = lambda x: F.when(F.col(own)["tokens"] > 0, F.coalesce(F.col(cell)[x], F.lit(0.0))).otherwise(0.0)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11) / float(1 << 53)
    every = F.struct(*(F.col(own)[x].alias(x) for x in (*DIMENSIONS, "tokens")), value("weight").alias("weight"), value("probability").alias("probability"), F.coalesce(F.col(cell)["deviation"], F.lit(0.0)).alias("deviation"), (chance < value("probability")).alias("kept"))
    return out.withColumn(name, every).select(*docs.columns, name), name


def weighted(docs: DataFrame, targets=None, doc_id: str = "doc_id", text: str = "text", dims: dict[str, Column] | None = None, seed: int = 17, share: float = SHARE, budget: int | None = None) -> DataFrame:
    """docs with _source, _lang, _topic, _tokens, _weight, _probability, _deviation and _kept, which replace columns of those names.

    dims: the three dimensions of a table that has a topic; else the columns source and lang
    and learned topics.  budget: the tokens to expect of the sample, all if it has fewer.
    Null values of a dimension are a value of their own.  Documents without words (null,
    empty and blank texts) have weight and probability 0 and are not kept: they add nothing
    to any marginal.  Every word of a very long text counts.  A null id is hashed like a
    value of its own; repeated ids share one decision if their cells do; an empty table
    gives an empty result.
    """
    out, name = decided(docs, targets, doc_id, text, dims, seed, share, budget)
    names = {f"_{x}": F.col(name)[x] for x in (*DIMENSIONS, "tokens", "weight", "probability", "deviation", "kept")}
    return out.select(*(c for c in docs.columns if c.lower() not in names), *(c.alias(x) for x, c in names.items()))


def sample(docs: DataFrame, targets=None, doc_id: str = "doc_id", text: str = "text", dims=None, seed: int = 17, share: float = SHARE, budget: int | None = None) -> DataFrame:
    """The sampled rows of docs with their own columns, whatever their names; see weighted."""
    out, name = decided(docs, targets, doc_id, text, dims, seed, share, budget)
    return out.where(F.col(name)["kept"]).select(*docs.columns)


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Query: cell, weight, probability, decision and remaining deviation of every document; numbers rounded to 6 digits."""
    out = weighted(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"), F.round("_deviation", 6).alias("deviation"), F.col("_kept").alias("kept"))
