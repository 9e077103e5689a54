"""JSON bodies as a browser's runtime reads and writes them: what Spark's JSON functions keep differently.

Of repeated members the last counts, in the place of the first; members keep their order,
whole numbers as names first; a number is written in its shortest form, so 1.0 as 1 and
1e3 as 1000; nothing may stand behind the value.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal


def _refuse(name: str):
    raise ValueError(name)


def read(body: str):
    """The value of a body; ValueError where it is none, or nested deeper than some hundred levels."""
    try:
        return json.loads(body.removeprefix("﻿"), parse_int=float, parse_constant=_refuse)
    except RecursionError as error:
        raise ValueError("nested too deep") from error


def text(value: str) -> str:
    """value with halves of surrogate pairs replaced, which no UTF-8 text can hold."""
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def write(value) -> str:
    """value as text."""
    if isinstance(value, dict):
        index = lambda k: k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 4294967295
        names = sorted(filter(index, value), key=int) + [k for k in value if not index(k)]
        return "{" + ",".join(f"{write(k)}:{write(value[k])}" for k in names) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(write, value)) + "]"
    if isinstance(value, str):
        return "".join(f"\\u{ord(c):04x}" if "\ud800" <= c <= "\udfff" else c for c in json.dumps(value, ensure_ascii=False))
    if isinstance(value, float):
        return number(value)
    return json.dumps(value)


def number(x: float) -> str:
    """A number in the shortest form that reads back as it."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    figures, point = "".join(map(str, digits)), len(digits) + exponent
    if len(figures) <= point <= 21:
        out = figures + "0" * (point - len(figures))
    elif 0 < point <= 21:
        out = f"{figures[:point]}.{figures[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + figures
    else:
        out = figures[0] + ("." + figures[1:] if figures[1:] else "") + f"e{point - 1:+d}"
    return "-" * sign + out
