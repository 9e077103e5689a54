"""Near-duplicate documents by MinHash: a multi-index Hamming join over b-bit signatures.

A document's signature has SYMBOLS positions of 16 bits, each the low bits of one
minimum over its shingles.  Two documents at Jaccard similarity s differ in a position
with probability 1 - s.  Documents are compared when they differ in at most REACH
positions: the positions are split into chunks of WIDTH, two signatures within REACH
then agree in some chunk but for one position (pigeonhole), and a key for each chunk
and each position left out enumerates that error.  So every pair within REACH meets
under some key.  At s = 0.8 a pair lies beyond REACH with probability 1.44e-4, at 0.85
with 3.5e-6 (binomial tails); unrelated documents meet under a key with probability 2**-48.

Links come from the exact shingle sets of the documents that signatures bring
together (64-bit shingle hashes).  Documents with equal sets are one vertex all along,
so copies cost nothing; large groups are compared in blocks (see linking).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import settle
from inkstone.llm.linking import link, span
from inkstone.llm.wordhash import document_words, mix64, shingle_hashes

SYMBOLS, WIDTH = 32, 4
CHUNKS = SYMBOLS // WIDTH
REACH = 2 * CHUNKS - 1
#: Members, and thousands of shingles plus members, that a task compares at once.
SIGNATURE_BLOCK, SET_BLOCK = 2048, 2048

_U = np.uint64
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_KEY = _rng.integers(0, 2**62, (CHUNKS * WIDTH, WIDTH), dtype=_U) * _U(2) + _U(1)
_FREE = np.ones((CHUNKS * WIDTH, WIDTH), dtype=_U)
for _k in range(CHUNKS * WIDTH):
    _FREE[_k, _k % WIDTH] = 0


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS minima, cut to 16 bits, of a non-empty array of 64-bit hashes; repeats change nothing."""
    low = hashes.astype(np.uint32)
    out = np.empty(SYMBOLS, dtype=np.uint16)
    for i in range(SYMBOLS):
        out[i] = ((low ^ _XOR[i]) * _MUL[i]).min() & np.uint32(0xFFFF)
    return out


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The n x SYMBOLS keys of n signatures: one for each chunk and each of its positions left out."""
    chunks = signatures.reshape(-1, CHUNKS, 1, WIDTH).astype(_U) + _U(1)
    free = (_KEY * _FREE).reshape(1, CHUNKS, WIDTH, WIDTH)
    mixed = (chunks * free).sum(-1, dtype=_U).reshape(-1, CHUNKS * WIDTH)
    return mix64(mixed + np.arange(1, CHUNKS * WIDTH + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _sketches(k: int):
    def run(batches):
        for batch in batches:
            for row, words, cut in document_words(batch.column(1)):
                n = len(cut) - 1
                size, one, two = np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, _U)
                sig = np.zeros((n, SYMBOLS), np.uint16)
                for i in range(n):
                    x = shingle_hashes(words[cut[i] : cut[i + 1]], k)
                    if len(x):
                        x = np.sort(x)
                        x = x[np.concatenate(([True], x[1:] != x[:-1]))]
                        size[i], sig[i] = len(x), signature(x)
                        one[i], two[i] = x.sum(dtype=_U), mix64(x * _U(0xD6E8FEB86659FD93)).sum(dtype=_U)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n).cast(pa.int64()), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(list(map(bytes, sig)), pa.binary())],
                    ["id", "n", "h1", "h2", "sig"],
                )

    return run


def _keys(batches):
    for batch in batches:
        sig = _matrix(batch.column("sig"))
        keys = keys_of(sig)
        ids = np.repeat(batch.column("id").to_numpy(), SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], ["key", "id"])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, _, data = column.cast(pa.large_binary()).buffers()
    at = column.offset * SYMBOLS
    return np.frombuffer(data, dtype=np.uint16)[at : at + len(column) * SYMBOLS].reshape(-1, SYMBOLS)


def _signatures(rows: pa.Table) -> np.ndarray:
    return _matrix(rows["sig"])


def _near_signatures(sig: np.ndarray, lo: int, hi: int, fresh, old) -> np.ndarray:
    sig = sig[lo:hi]
    if hi - lo == 2:
        return np.array([[1, 0]] if (sig[0] != sig[1]).sum() <= REACH and (old is None or old[0] != old[1]) else [], dtype=int).reshape(-1, 2)
    return span(hi - lo, lambda i: i + 1 + np.flatnonzero((sig[i + 1 :] != sig[i]).sum(1) <= REACH), fresh, old)


def _sets(k: int):
    """(id, its sorted distinct shingle hashes as bytes)."""

    def run(batches):
        for batch in batches:
            for row, words, cut in document_words(batch.column(1)):
                n = len(cut) - 1
                sets = [np.unique(shingle_hashes(words[cut[i] : cut[i + 1]], k)).tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n).cast(pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _set_arrays(rows: pa.Table):
    col = rows["set"].combine_chunks() if rows["set"].num_chunks != 1 else rows["set"].chunk(0)
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1] // 8
    return np.frombuffer(data, dtype=_U)[: offsets[-1]], offsets


def _near_sets(percent: int):
    def edges(arrays, lo: int, hi: int, fresh, old) -> np.ndarray:
        data, offsets = arrays
        size = np.diff(offsets[lo : hi + 1])
        order = np.argsort(size, kind="stable")  # a link needs sizes within the threshold of each other
        size = size[order]
        parts = [data[offsets[lo + r] : offsets[lo + r + 1]] for r in order]
        words, which = np.unique(np.concatenate(parts), return_inverse=True)
        at = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(len(words), np.int32)
        last = np.searchsorted(size * percent, size * 100, "right")

        def near(i: int) -> np.ndarray:
            j = last[i]
            if j <= i + 1:
                return np.empty(0, int)
            own = which[at[i] : at[i + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[which[at[i + 1] : at[j]]], at[i + 1 : j] - at[i + 1])
            mark[own] = 0
            return i + 1 + np.flatnonzero(100 * both >= percent * (size[i] + size[i + 1 : j] - both))

        pairs = span(hi - lo, near, None if fresh is None else fresh[order], None if old is None else old[order])
        return order[pairs] if len(pairs) else pairs

    return edges


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """Components of near-duplicate documents: (id, n_shingles, component, kept), one row per row of docs.

    A document's set holds its distinct k-word shingles (ASCII lower case, words split
    at ASCII white space); one with fewer words has the whole sequence as its only
    shingle; null, empty and blank texts have an empty set and link with nothing.
    Documents are linked when 100 * |A and B| >= percent * |A or B|; component is the
    smallest id reachable.  Rows that share an id are one vertex.  A row with a null id
    is returned with a null component and kept = false.  Other columns are not read, so
    their names can't clash; an empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = settle(docs.mapInArrow(_sketches(k), "id long, n long, h1 long, h2 long, sig binary"))
    # Equal sets are one vertex: the smallest id stands for them.
    full = sketch.where("n > 0 and id is not null")
    classes = settle(full.groupBy("h1", "h2", "n", "sig").agg(F.min("id").alias("rep")))
    one = classes.select(F.col("rep").alias("id"), "n", "sig")
    keys = settle(one.select("id", "sig").mapInArrow(_keys, "key long, id long")).withColumn("weight", F.lit(1))
    close = settle(link(keys, "key", one.select("id", "sig"), _signatures, _near_signatures, SIGNATURE_BLOCK))
    # The exact sets of those that signatures bring together, and of no others.
    members = close.join(one.select("id", "n"), "id").select(F.col("component").alias("group"), "id", (1 + F.col("n") / 1000).alias("weight"))
    sets = docs.join(close.select("id"), "id", "left_semi").mapInArrow(_sets(k), "id long, set binary")
    found = link(members, "group", sets, _set_arrays, _near_sets(percent), SET_BLOCK)
    labelled = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.col("n").alias("m"), F.coalesce("component", "rep").alias("component"))
    out = sketch.drop("sig").alias("s").join(labelled.alias("c"), (F.col("s.h1") == F.col("c.h1")) & (F.col("s.h2") == F.col("c.h2")) & (F.col("s.n") == F.col("c.m")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: components of documents at 4-word-shingle similarity of 0.8 or more."""
    from inkstone.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


#: The same by comparing all pairs that share a shingle; a recursive walk finds the components.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
