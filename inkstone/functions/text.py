"""Text expressions with browser semantics: white space, trimming, snippets, hashes.

Lengths and positions count code points.  SPACE is the class of characters that trimming
removes; it holds the byte order mark and the ideographic space, which Java's \\s lacks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x{09}-\x{0d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
CJK = r"[\x{3400}-\x{9fff}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), rf"{SPACE}+", " "))


def lines(c: Column | str) -> Column:
    """The lines of a text; one after a final line end counts."""
    return F.split(col(c), r"\r?\n", -1)


def preview(c: Column | str, n: int = 300) -> Column:
    return trim(F.regexp_replace(F.substring(col(c), 1, n), r"\r?\n", " "))


def or_else(c: Column | str, *others: Column) -> Column:
    """The first that is neither null nor empty; the last as it is."""
    return F.coalesce(F.nullif(col(c), F.lit("")), *others)


def window_of(text: Column, pos: Column, length: Column, before: int, after: int, squeeze: bool) -> Column:
    """What surrounds a match at 0-based pos, with an ellipsis wherever text is left out."""
    start = F.greatest(F.lit(0), pos - before)
    end = F.least(F.length(text), pos + length + after)
    body = F.substring(text, start + 1, end - start)
    return F.concat(F.when(start > 0, "…").otherwise(""), collapse(body) if squeeze else body, F.when(end < F.length(text), "…").otherwise(""))


def occurrences(text: Column, term: Column, most: int = 100) -> Column:
    """Non-overlapping matches of a literal term, counted up to `most`; 0 for an empty term."""
    found = (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)
    return F.when(F.length(term) > 0, F.least(F.lit(most), found.cast("int"))).otherwise(0)


def characters(text: Column) -> Column:
    """The code points of a text, as an array."""
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def grams(text: Column, size: int, least: int | None = None) -> Column:
    """The grams that begin at each place of a text, in order, and shorter ones down to `least` characters there too.

    At the end of the text they are cut; an empty or null text has none.
    """
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    one = lambda c, n: F.transform(c, lambda x, i: F.concat(x, *(at(c, i + k) for k in range(1, n))))
    every = lambda c: F.concat(*(one(c, n) for n in range(size if least is None else least, size + 1)))
    # Bound by a lambda, the characters are found once and not for each place.
    return F.get(F.transform(F.array(characters(F.coalesce(text, F.lit("")))), every), F.lit(0))


def stable_id(name: Column | str) -> Column:
    """16 hex digits of a name."""
    return F.substring(F.sha2(col(name), 256), 1, 16)


def poly31(c: Column | str) -> Column:
    """The 31-polynomial 32-bit hash of a text of 16-bit characters, as a signed number."""
    wrap = F.lit(1 << 31)
    return F.aggregate(
        F.filter(F.split(col(c), ""), lambda x: x != ""),
        F.lit(0).cast("long"),
        lambda h, x: (h * 31 + F.ascii(x) + wrap).bitwiseAND(F.lit((1 << 32) - 1)) - wrap,
    )


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def url_component(c: Column | str) -> Column:
    return F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))


def percent(part: Column, whole: Column) -> Column:
    """Two decimals and a sign; a dash where there is nothing to divide by."""
    return F.when(whole > 0, F.format_string("%.2f%%", part / whole * 100)).otherwise("-")
