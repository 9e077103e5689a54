"""From a question to the passages that help to answer it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.functions.variants import variants_of
from inkstone.sources.stage import settle

#: Phrases that ask, longer ones before those they hold, and what separates terms.
ASKING = (
    "有什么", "是什么", "什么是", "什么叫", "为什么", "什么样", "什么",
    "怎么样", "怎么", "如何", "为何", "是不是", "有没有", "有哪些",
    "哪些", "哪个", "哪里", "谁是", "多少",
    "请问", "请解释", "解释一下", "介绍一下", "讲讲", "说说", "告诉我",
    "的意思", "的含义", "意思", "含义", "区别", "关系", "异同",
    "是", "的", "和", "与", "或", "了", "吗", "呢", "啊", "这", "那", "它", "一下",
)
BREAKS = r"[，。？！、；：\s「」『』（）()？?!.,]+"
TITLES, CONCEPTS, PER_CONCEPT, ENOUGH = 3, 3, 2, 5
#: Grams up to which a text is searched for each, before its own are listed and joined; the rows are the same.
FEW = 256


def titles(question: Column) -> Column:
    """Book titles of 1 to 20 characters that a question names."""
    return F.regexp_extract_all(question, F.lit("《([^》]{1,20})》"), 1)


def concepts(question: Column, most: int = CONCEPTS) -> Column:
    """The first distinct terms of 2 to 8 characters that remain of a question."""
    rest = F.regexp_replace(F.regexp_replace(question, "《[^》]*》", "，"), "|".join(ASKING), "，")
    parts = F.transform(F.split(rest, BREAKS), T.trim)
    return F.slice(F.array_distinct(F.filter(parts, lambda p: p.rlike(rf"^{T.CJK}{{2,8}}\z"))), 1, most)


def references_of(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Citations for a table of questions (question_id, q, book_id, book_title, block_id: what is being read, or null).

    (question_id, place, book_id, book_title, block_id, quote, source) in order: the named
    titles, each by the first entry that matches; then the best passages for each concept,
    no further concept once ENOUGH books are cited; then what is being read.  A book is
    cited once.  Terms meet the documents by their rarest grams, in equi-joins.
    """
    spark = docs.sparkSession
    asked = settle(questions.select("question_id", titles(F.col("q")).alias("t"), concepts(F.col("q")).alias("c"), "book_id", "book_title", "block_id"))
    named = asked.select("question_id", F.posexplode(F.slice("t", 1, TITLES)).alias("place", "term"))
    named = settle(named.withColumn("variants", variants_of(spark, F.col("term"))))
    known = settle(_met(docs, named, "named").groupBy("question_id", "place", "term").agg(F.min_by(F.struct("id", "title", "preview"), "ord").alias("book")))
    # A title of one character is looked up in the texts by the book's own title.
    by_title = known.select("question_id", F.lit(0).alias("step"), "place", F.when(F.length("term") >= 2, F.col("term")).otherwise(F.col("book.title")).alias("term"))
    by_concept = asked.select("question_id", F.posexplode("c").alias("place", "term")).select("question_id", (F.col("place") + 1).alias("step"), F.lit(0).alias("place"), "term")
    terms = settle(by_title.unionByName(by_concept).withColumn("variants", variants_of(spark, F.col("term"))))
    rank = F.row_number().over(Window.partitionBy("question_id", "step", "place").orderBy(F.desc("title_hit"), F.desc("match_count"), "ord"))
    best = _met(docs, terms, "text").withColumn("rank", rank).where(F.col("rank") <= PER_CONCEPT)
    best = settle(best.select("question_id", "step", "place", "rank", "id", "title", "snippet", "term"))
    top = best.where("step = 0 and rank = 1").select("question_id", "place", F.col("id").alias("_top"), "snippet")
    quote = F.when(F.col("_top") == F.col("book.id"), F.col("snippet")).otherwise(F.substring("book.preview", 1, 150))
    first = known.join(top, ["question_id", "place"], "left").select("question_id", F.lit(0).alias("step"), "place", F.col("book.id").alias("id"), F.col("book.title").alias("title"), quote.alias("quote"), F.lit("title").alias("source"))
    then = best.where("step > 0").select("question_id", "step", F.col("rank").alias("place"), "id", "title", F.col("snippet").alias("quote"), F.col("term").alias("source"))
    every = first.unionByName(then).groupBy("question_id", "id").agg(F.min(F.struct("step", "place", "title", "quote", "source")).alias("x")).select("question_id", "id", "x.*")
    # A concept is looked up only while too few books are cited by the steps before it.
    before = Window.partitionBy("question_id").orderBy("step").rangeBetween(Window.unboundedPreceding, -1)
    kept = settle(every.withColumn("_n", F.count("id").over(before)).where(F.col("_n") < ENOUGH))
    cited = kept.select("question_id", "step", "place", F.col("id").alias("book_id"), F.col("title").alias("book_title"), F.lit(None).cast("string").alias("block_id"), F.substring("quote", 1, 100).alias("quote"), "source")
    own = asked.where(F.coalesce("book_id", F.lit("")) != "").join(kept.select("question_id", F.col("id").alias("book_id")), ["question_id", "book_id"], "left_anti")
    read = own.select("question_id", F.lit(9).alias("step"), F.lit(0).alias("place"), "book_id", F.coalesce("book_title", F.lit("")).alias("book_title"), "block_id", F.lit(None).cast("string").alias("quote"), F.lit("reading").alias("source"))
    order = Window.partitionBy("question_id").orderBy("step", "place")
    return cited.unionByName(read).withColumn("place", F.row_number().over(order)).drop("step")


def _met(docs: DataFrame, terms: DataFrame, where: str) -> DataFrame:
    """terms with every document that matches one: by its text (with snippet, match_count and title_hit) or by its title, author and preview."""
    named = where == "named"
    low = F.lower if named else (lambda c: F.col(c) if isinstance(c, str) else c)
    text = F.lower(F.concat_ws("\n", "title", "author", "preview")) if named else F.col("content")
    pairs = holding(docs.select("id", text.alias("text")), terms.select("term", F.explode("variants").alias("variant")).distinct().select("term", low(F.col("variant")).alias("variant")))
    found = pairs.select("term", "id").distinct().join(terms, "term")
    if named:
        # What was found by the joined fields is checked in each of them.
        holds = lambda c: F.exists("variants", lambda v: F.coalesce(F.contains(F.lower(c), F.lower(v)), F.lit(False)))
        return found.join(docs.select("id", "ord", "title", "author", "preview"), "id").where(holds("title") | holds("author") | holds("preview"))
    rows = found.join(docs.select("id", "ord", "title", "content"), "id")
    met = F.transform("variants", lambda v, i: F.struct(F.instr(F.col("content"), v).alias("pos"), i.alias("i"), v.alias("term")))
    rows = rows.withColumn("_f", F.array_min(F.filter(met, lambda x: x["pos"] > 0))).where("_f is not null")
    matched, pos = F.col("_f.term"), F.col("_f.pos") - 1
    snippet = T.window_of(F.col("content"), pos, F.length(matched), 40, 40, True)
    return rows.withColumns({"match_count": T.occurrences(F.col("content"), matched), "snippet": snippet, "title_hit": F.exists("variants", lambda v: F.coalesce(F.contains("title", v), F.lit(False)))}).drop("_f", "content")


def holding(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id) of all texts (id, text) that can hold a variant of terms (term, variant): those with its rarest gram.

    Grams are pairs of characters, or single ones for a variant of one.  Texts are read
    once, whatever the number of terms, for the grams that occur in any variant; their
    counts tell each variant's rarest gram, and an equi-join by it gives the candidates,
    no text that holds a variant missing.  A variant with a gram that no text has is held
    by none.  Nulls and empty variants match nothing.
    """
    pieces = terms.where("variant <> ''").select("term", "variant", F.explode(F.array_distinct(F.filter(T.grams(F.col("variant"), 2), lambda g: (F.length(g) == 2) | (F.length("variant") == 1)))).alias("gram"))
    pieces = settle(pieces)
    # A text's pairs, and its characters where a variant is one character.
    single = pieces.where(F.length("gram") == 1).limit(1).count() > 0
    own = T.grams(F.col("text"), 2, 1 if single else 2)
    wanted = pieces.select("gram").distinct()
    few = [r[0] for r in wanted.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        had = texts.select("id", F.explode(F.filter(F.array(*map(F.lit, few)).cast("array<string>"), lambda g: F.contains("text", g))).alias("gram"))
    else:
        had = texts.select("id", F.explode(F.array_distinct(own)).alias("gram")).join(wanted, "gram", "left_semi")
    had = settle(had)
    counts = had.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = pieces.join(counts, "gram", "left").groupBy("term", "variant").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    keys = rarest.where("r.n > 0").select("term", F.col("r.gram").alias("gram")).distinct()
    return had.join(keys, "gram").select("term", "id")


def references(spark: SparkSession, docs: DataFrame, question: str, reading: dict | None = None) -> list[dict]:
    """Citations for one question, in order; a handful of rows reaches the driver."""
    own = reading or {}
    asked = spark.createDataFrame([(0, question, own.get("book_id"), own.get("book_title"), own.get("block_id"))], "question_id long, q string, book_id string, book_title string, block_id string")
    return [{k: r[k] for k in ("book_id", "book_title", "block_id", "quote", "source")} for r in references_of(docs, asked).orderBy("place").collect()]
