"""Secrets in texts: Aho-Corasick keywords, regular expressions anchored at the hits, checksums.

One pass of an Aho-Corasick automaton over the lower-cased text finds the keywords;
each kind's expression is tried only where one of its keywords begins.  Runs of hex
digits have no keyword, so their anchors are bytes: a run of 24 covers three positions in
a row of a grid of step 8, which array operations find over a whole batch at once; the
expression is tried around those.  Token kinds with a checksum inside (six base-62
digits of a CRC-32) are reported only where it holds.

Texts are scanned whole.  A row needs memory in proportion to its own text.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import table
from inkstone.llm.wordhash import texts

#: Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "forge", "registry")
#: The expressions by kind, each of which begins with one of its keywords.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"(AKIA[A-Z0-9]+)")
_HEX = re.compile(r"[0-9a-f]+")
_FORGE = re.compile(r"(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_REGISTRY = re.compile(r"(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "registry": ("npm_",)}

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_STEP = 8
#: ASCII only, so that positions stay those of the text.
_LOWER = {i: i + 32 for i in range(65, 91)}


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of body."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for w in words:
            a.add_word(w, (len(w), kind))
    a.make_automaton()
    return a


def _hex_rows(column) -> np.ndarray:
    """True for each row that may hold a run of 24 hex digits: three marks in a row on the grid."""
    data, offsets = texts(column)
    grid = _HEX_BYTE[data[::_STEP]]
    three = np.flatnonzero(grid[:-2] & grid[1:-1] & grid[2:]) * _STEP if len(grid) > 2 else np.empty(0, int)
    out = np.zeros(len(column), bool)
    # The run may cross into the next row on the grid; either way its row is tried.
    out[np.searchsorted(offsets, three, "right") - 1] = True
    return out


def find(text: str, keywords: list[tuple[int, str]], hex_run: bool) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of every span of text, sorted; keywords: (start, kind) of the automaton's hits in order."""
    out, past = [], {"assign": 0, "access": 0, "forge": 0, "registry": 0}
    for start, kind in keywords:
        if start < past[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(text, start):
                past[kind] = m.end()
                if m.end() - m.start(2) >= 6:
                    out.append((start, 0, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                past[kind] = m.end()
                if m.end() - start >= 20:
                    out.append((start, 1, m.end()))
        elif m := (_FORGE if kind == "forge" else _REGISTRY).match(text, start):
            past[kind] = m.end()
            body = m[1][4:]
            if checksum(body[:30]) == body[30:]:
                out.append((start, KINDS.index(kind), m.end()))
    if hex_run:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _scan(batches):
    automaton = _automaton()
    for batch in batches:
        tried = _hex_rows(batch.column(1))
        found = []
        for i, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            low = text.lower()
            # Lower-casing may change the length of some letters; then only ASCII letters are lowered.
            if len(low) != len(text):
                low = text.translate(_LOWER)
            hits = sorted((end - n + 1, kind) for end, (n, kind) in automaton.iter(low))
            found.append(find(text, hits, bool(tried[i])))
        show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        count = lambda kind: pa.array([sum(k == kind for _, k, _ in spans) for spans in found], pa.int64())
        base = [hashlib.sha256(show([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array(list(map(show, found)), pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of secrets per row: (id, n_assign, n_access, n_hex, base_sha256, spans).

    spans lists kind:start:end (code points, end exclusive) by start, then kind; base_sha256
    is the SHA-256 of the same list of the three base kinds.  A null text counts as empty:
    no spans and the hash of the empty string.  Repeated rows and null ids are returned as
    they come; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each found span of text replaced by [kind]; overlapping spans are replaced as one, named after the first."""

    def run(batches):
        automaton = _automaton()
        for batch in batches:
            tried, at = _hex_rows(batch.column(text)), batch.schema.get_field_index(text)
            out = []
            for i, value in enumerate(batch.column(at).to_pylist()):
                if value is None:
                    out.append(None)
                    continue
                low = value.lower()
                low = low if len(low) == len(value) else value.translate(_LOWER)
                pieces, past = [], 0
                for start, kind, end in find(value, sorted((e - n + 1, k) for e, (n, k) in automaton.iter(low)), bool(tried[i])):
                    if start >= past:
                        pieces += [value[past:start], f"[{KINDS[kind]}]"]
                    past = max(past, end)
                out.append("".join(pieces) + value[past:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Query: the secrets of every document."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_SQL_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: The base kinds by plain expressions. Checksums are beyond it: it holds for tables without tokens that carry a valid one.
OP5_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, 0 AS k, regexp_extract_all(text, '{_SQL_ASSIGN}') AS ms FROM t
  UNION ALL SELECT doc_id, text, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT doc_id, text, 2, regexp_extract_all(text, '[0-9a-f]{{24,}}') FROM t),
p AS (SELECT doc_id, text, k, ms, 1 AS i, instr(text, ms[1]) - 1 AS s FROM m WHERE len(ms) > 0
  UNION ALL SELECT doc_id, text, k, ms, i + 1, s + length(ms[i]) + instr(substr(text, s + length(ms[i]) + 1), ms[i + 1]) - 1 FROM p WHERE i < len(ms)),
f AS (SELECT doc_id, k, s, ['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || (s + length(ms[i])) AS span FROM p
  WHERE CASE k WHEN 0 THEN length(regexp_extract(ms[i], '{_SQL_ASSIGN}', 2)) >= 6 WHEN 1 THEN length(ms[i]) >= 20 ELSE true END),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(span, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""
