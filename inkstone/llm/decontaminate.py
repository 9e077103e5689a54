"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become words (lower case, letters and digits).  At every word a seed is hashed for
each mask, from the words that the mask selects; positions that it ignores may differ.
Seeds of training documents are joined with seeds of benchmark items, each hit fixes an
alignment of one document with one item, and along each alignment the words are compared:
a match counts 1, a substitution -PENALTY, and the best run of words is the overlap.  A
document is contaminated by an item when the overlap reaches LEAST, or SHARE of the words
of a shorter item.

Items shorter than a mask are met by an exact hash of their whole word sequence.  Items of
up to BRIEF words also give a hash of every run of RUN words and one for the mask CENTRE,
and the bound counts their matched words, so that one word replaced anywhere in an item of
7 to 11 words is tolerated (from 8 words on the two masks alone find it; two replaced words
are found where some mask leaves both out).  The documents are hashed for those masks and
lengths only that such items have.  Items of one or two words are found where the caller
asks for them (fewest); clean() doesn't, since they are no passage.

The benchmark's seeds are counted; up to BROADCAST rows they are broadcast, beyond that
the join shuffles.  All words of all texts give seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import free, settle, table

#: Selected positions of each mask: 1101011 and 1011101 for all items; 111111 at either end of seven words and 1110111 for brief ones.
SPACED = ((0, 1, 3, 5, 6), (0, 2, 3, 4, 6))
RUN, CENTRE = 6, (0, 1, 2, 4, 5, 6)
MASKS = (*SPACED, (0, 1, 2, 3, 4, 5), (1, 2, 3, 4, 5, 6), CENTRE)
SPAN = 7
#: Words of the shortest item that clean() looks for; of the longest whose bound counts matched words.
FEWEST, BRIEF = 3, 11
PENALTY, LEAST, SHARE = 2, 10, 0.75
BROADCAST = 1_000_000


def words(text: str) -> Column:
    """The words of a text column; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(df: DataFrame, key: str, text: str, place: str) -> DataFrame:
    """(key, place, seed): the hashes of both spaced masks at every word."""
    # No filter on the words' number: pushed below the projection it would compute them again.
    hashed = df.select(F.col(key), F.transform(words(text), lambda w: F.xxhash64(w)).alias("_h"))
    n = F.size("_h") - (SPAN - 1)
    at = lambda i, k: F.get("_h", i + k if k else i)

    def seed(p: Column) -> Column:
        i = F.shiftright(p, 1)
        first, second = (F.xxhash64(F.lit(m), *(at(i, k) for k in mask)) for m, mask in enumerate(SPACED))
        return F.when(p.bitwiseAND(1) == 0, first).otherwise(second)

    each = F.when(n > 0, F.transform(F.sequence(F.lit(0), 2 * n - 1), seed))
    return hashed.select(key, F.posexplode(each).alias("_p", "seed")).select(key, F.shiftright("_p", 1).alias(place), "seed")


def masked(df: DataFrame, key: str, text: str, place: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """(key, place, size, seed): the hashes of the masks at every word, all in one pass; size: the mask's number of words."""
    hashed = df.select(F.col(key), F.transform(words(text), lambda w: F.xxhash64(w)).alias("_h"))

    def each(mask: tuple[int, ...]) -> Column:
        last = F.size("_h") - (mask[-1] + 1)
        one = lambda i: F.struct(i.alias("p"), F.lit(len(mask)).alias("size"), F.xxhash64(F.lit(str(mask)), *(F.get("_h", i + k) for k in mask)).alias("seed"))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<struct<p:int,size:int,seed:bigint>>"))

    return hashed.select(key, F.explode(F.concat(*map(each, masks))).alias("_s")).select(key, F.col("_s.p").alias(place), "_s.size", "_s.seed")


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", fewest: int = 1) -> DataFrame:
    """(id, item, overlap, words): the best overlap of each contaminated document with each item.

    overlap is the best run's score, for items of up to BRIEF words the number of matched
    words if that is more.  Rows with a null id or text on either side, texts without a
    word and items of fewer than `fewest` words match nothing; rows that share an id count
    as one document; of a very long text every word is hashed; other columns are not read;
    an empty table on either side gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    items = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("item_text")).where("item is not null and item_text is not null")
    size = F.size(words("item_text"))
    lengths = sorted(r.n for r in items.select(size.alias("n")).where(F.col("n").between(fewest, BRIEF)).distinct().collect())
    theirs = _bounded(seeds(items, "item", "item_text", "j"))
    hits = seeds(docs, "id", "text", "i").join(theirs, "seed").select("id", "item", (F.col("i") - F.col("j")).alias("shift"))
    if brief := [n for n in lengths if n >= SPAN]:
        masks = [tuple(range(RUN)), CENTRE]
        own = _bounded(masked(items.where(size.between(SPAN, brief[-1])), "item", "item_text", "j", masks).drop("size"))
        hits = hits.unionByName(masked(docs, "id", "text", "i", masks).join(own, "seed").select("id", "item", (F.col("i") - F.col("j")).alias("shift")))
    lines = hits.groupBy("id", "item", "shift").agg(F.count("*").alias("n"))
    if whole := [n for n in lengths if n < SPAN]:
        masks = [tuple(range(n)) for n in whole]
        own = _bounded(masked(items.where(size < SPAN), "item", "item_text", "j", masks).join(items.select("item", size.alias("size")).distinct(), ["item", "size"], "left_semi").select("item", "seed"))
        # One alignment is enough, however often a document repeats a short item.
        same = masked(docs, "id", "text", "i", masks).join(own, "seed").groupBy("id", "item").agg(F.min("i").alias("shift"), F.count("*").alias("n"))
        lines = lines.unionByName(same.select(*lines.columns))
    lines = settle(lines)
    ours = docs.join(lines.select("id").distinct(), "id").select("id", words("text").alias("dw"))
    pairs = lines.join(ours, "id").join(items.select("item", words("item_text").alias("tw")).join(lines.select("item").distinct(), "item", "left_semi"), "item")
    skip = F.greatest(F.lit(0), -F.col("shift"))
    length = F.least(F.size("dw") - F.col("shift") - skip, F.size("tw") - skip)
    pairs = pairs.where(length > 0).select("id", "item", F.size("tw").alias("words"), F.zip_with(F.slice("dw", F.col("shift") + skip + 1, length), F.slice("tw", skip + 1, length), lambda a, b: a == b).alias("same"))
    run = F.aggregate(
        "same",
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, same: F.struct(F.greatest(F.lit(0), s["run"] + F.when(same, 1).otherwise(-PENALTY)).alias("run"), F.greatest(s["best"], s["run"] + F.when(same, 1).otherwise(-PENALTY)).alias("best")),
        lambda s: s["best"],
    )
    matched = F.when(F.col("words") <= BRIEF, F.size(F.filter("same", lambda same: same))).otherwise(0)
    best = pairs.select("id", "item", "words", F.greatest(run, matched).alias("overlap"))
    best = best.groupBy("id", "item").agg(F.max("overlap").alias("overlap"), F.max("words").alias("words"))
    return best.where(F.col("overlap") >= F.least(F.lit(LEAST), F.ceil(F.col("words") * SHARE)))


def _bounded(theirs: DataFrame) -> DataFrame:
    """The benchmark's distinct seeds, written; broadcast where they are at most BROADCAST."""
    theirs = settle(theirs.distinct())
    return F.broadcast(theirs) if theirs.count() <= BROADCAST else theirs


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", fewest: int = FEWEST) -> DataFrame:
    """The rows of docs, with all their columns, that no item of `fewest` words or more contaminates.

    Rows with a null id or text stay, and all rows where either table is empty; rows that
    share an id stay or go together.
    """
    key = free(docs.columns, "bad")
    bad = settle(overlaps(docs, items, doc_id, text, fewest=fewest).select(F.col("id").alias(key)).distinct())
    return docs.join(bad, F.col(doc_id).cast("long") == F.col(key), "left_anti")


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Query: every document with the benchmark items that it contains.

    (doc_id, contaminated, n_items, item_ids, overlap); item_ids joined by commas in
    order, empty for a clean document, overlap the best of them, 0 if none.
    """
    docs = table(spark, sf_dir, "documents")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    found = found.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x.cast("string")), ",").alias("items"), F.max("overlap").alias("o"))
    out = docs.select("doc_id").join(found, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("item_ids"), F.coalesce("o", F.lit(0)).cast("long").alias("overlap"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT item_id AS item, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT id, w, unnest(range(1, len(w) - 5)) AS i FROM d WHERE len(w) >= 7),
tp AS (SELECT item, w, unnest(range(1, len(w) - 5)) AS j FROM t WHERE len(w) >= 7),
ds AS (SELECT id, i, unnest([concat_ws(' ', 0, w[i], w[i+1], w[i+3], w[i+5], w[i+6]), concat_ws(' ', 1, w[i], w[i+2], w[i+3], w[i+4], w[i+6])]) AS seed FROM dp),
ts AS (SELECT item, j, unnest([concat_ws(' ', 0, w[j], w[j+1], w[j+3], w[j+5], w[j+6]), concat_ws(' ', 1, w[j], w[j+2], w[j+3], w[j+4], w[j+6])]) AS seed FROM tp),
db AS (SELECT id, i, 'c ' || array_to_string(w[i:i+2] || w[i+4:i+6], ' ') AS seed FROM dp UNION ALL SELECT id, i, 'r ' || array_to_string(w[i:i+5], ' ') FROM (SELECT id, w, unnest(range(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 6)),
tb AS (SELECT item, j, 'c ' || array_to_string(w[j:j+2] || w[j+4:j+6], ' ') AS seed FROM tp WHERE len(w) <= 11 UNION ALL SELECT item, j, 'r ' || array_to_string(w[j:j+5], ' ') FROM (SELECT item, w, unnest(range(1, len(w) - 4)) AS j FROM t WHERE len(w) BETWEEN 7 AND 11)),
sizes AS (SELECT DISTINCT len(w) AS n FROM t WHERE len(w) BETWEEN 1 AND 6),
dw AS (SELECT id, i, array_to_string(w[i:i+n-1], ' ') AS seed FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
lines AS (SELECT DISTINCT id, item, i - j AS shift FROM ds JOIN ts USING (seed) UNION SELECT id, item, i - j FROM db JOIN tb USING (seed)
  UNION SELECT id, item, i - 1 FROM dw JOIN (SELECT item, array_to_string(w, ' ') AS seed FROM t WHERE len(w) BETWEEN 1 AND 6) USING (seed)),
steps AS (SELECT id, item, shift, p, CASE WHEN dw[p + shift] = tw[p] THEN 1 ELSE -2 END AS v, len(tw) AS words
  FROM (SELECT lines.*, d.w AS dw, t.w AS tw, unnest(range(greatest(1, 1 - shift), least(len(t.w), len(d.w) - shift) + 1)) AS p FROM lines JOIN d USING (id) JOIN t USING (item))),
runs AS (SELECT *, sum(v) OVER (PARTITION BY id, item, shift ORDER BY p) AS s, CASE WHEN words <= 11 THEN count(*) FILTER (v = 1) OVER (PARTITION BY id, item, shift) ELSE 0 END AS matched FROM steps),
best AS (SELECT id, item, words, matched, s - least(0, min(s) OVER (PARTITION BY id, item, shift ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS run, s FROM runs),
found AS (SELECT id, item, max(words) AS words, greatest(0, max(coalesce(run, s)), max(matched)) AS overlap FROM best GROUP BY id, item),
kept AS (SELECT id, count(*) AS n, string_agg(item::VARCHAR, ',' ORDER BY item) AS items, max(overlap) AS o FROM found WHERE overlap >= least(10, ceil(words * 0.75)) GROUP BY id)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(items, '') AS item_ids, coalesce(o, 0)::BIGINT AS overlap FROM documents LEFT JOIN kept ON doc_id = id
"""
