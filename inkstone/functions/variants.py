"""Variants of a query: as written, in the standard traditional forms, and in those of Taiwan.

The session's ICU library holds the rules that turn simplified characters into traditional
ones: phrases, single characters, and a few that look at a neighbour.  They are read from it
once, and one function applies them, to a single query on the driver and to a column of
queries in Arrow batches alike: at each place the longest phrase that begins there counts.
A table then chooses among characters that have two traditional forms.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters with two traditional forms, the standard one first, the one of Taiwan second. Which forms these
#: are is set by the two standards; public lists, such as TWVariants of OpenCC (Apache License 2.0), have them too.
FORMS = "僞偽 啓啟 喫吃 嫺嫻 嬀媯 峯峰 幺么 擡抬 檐簷 泄洩 爲為 牀床 痹痺 癡痴 皁皂 着著 祕秘 竈灶 糉粽 繮韁 纔才 羣群 脣唇 蔿蒍 衆眾 裏裡 覈核 踊踴 鉢缽 鍼針 鮎鯰 麪麵 齶顎 臺台 眞真".split()
STANDARD = {b: a for a, b in FORMS}
TAIWAN = {a: b for a, b in FORMS}
#: What a browser trims.
BLANK = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A rule: perhaps characters of which one stands before, the phrase, perhaps characters of which one stands behind, and what the phrase becomes.
RULE = re.compile(r"(?:\[(.+?)\])?\{?([^\[\]{}]+)\}?(?:\[(.+?)\]|([^\[\]{}]+))? > (.+)")

Rules = dict[str, list[tuple[str, str, str, str]]]


@lru_cache(maxsize=4)
def rules(spark: SparkSession) -> Rules:
    """(before, phrase, behind, result) by the phrase's first character, longer phrases first; some 4,000 in all."""
    icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator
    found: Rules = {}
    for line in icu.getInstance("Hans-Hant").toRules(False).split(";"):
        if line.strip():
            before, phrase, behind, rest, result = RULE.fullmatch(line.strip()).groups()
            found.setdefault(phrase[0], []).append((before or "", phrase, behind or rest or "", result))
    for own in found.values():
        own.sort(key=lambda r: (-len(r[1]), not (r[0] or r[2])))
    return found


def traditional(found: Rules, text: str) -> str:
    """text in traditional characters."""
    out, at = "", 0
    while at < len(text):
        for before, phrase, behind, result in found.get(text[at], ()):
            end = at + len(phrase)
            # What stands before is converted already.
            if text.startswith(phrase, at) and (not before or out[-1:] in before and out) and (not behind or text[end : end + 1] in behind and end < len(text)):
                out, at = out + result, end
                break
        else:
            out, at = out + text[at], at + 1
    return out


def variants(found: Rules, query: str | None) -> list[str]:
    """Distinct variants in order, the query first; none for a blank or null query."""
    query = (query or "").strip(BLANK)
    if not query:
        return []
    full = traditional(found, query)
    return list(dict.fromkeys([query, *("".join(table.get(c, c) for c in full) for table in (STANDARD, TAIWAN))]))


def query_variants(spark: SparkSession, query: str) -> list[str]:
    """The variants of a single query."""
    return variants(rules(spark), query)


def variants_of(spark: SparkSession, query: Column) -> Column:
    """The array of variants of a column of queries; empty for a blank or null one."""
    found = rules(spark)

    @F.pandas_udf("array<string>")
    def every(queries: pd.Series) -> pd.Series:
        return queries.map(lambda q: variants(found, q))

    return every(query)
