"""Language identification by partial matching (PPM) over bytes.

Each language has a tree of byte contexts up to ORDER bytes long with the counts of the
bytes that followed them.  The frozen statistics give every byte an exact code length:
in its longest known context, -log2(n / (N + d)) if it was seen there, and otherwise the
escape -log2(d / (N + d)) plus its length in the next shorter context (N occurrences, d
distinct bytes; 8 bits below order 0).  A text goes to the language that codes it shortest.

The trees of all languages are merged into one hash table per order, whose entries hold
the finished code length in every language, so a byte takes one look-up in the common
case.  The model is fitted on the driver from PER_LANGUAGE documents of each language in
expectation, chosen by a hash of the id.  Of a longer text a slice of LONGEST characters is
taken, at a place that the hash gives, and where a language's sample would exceed SAMPLE
bytes all its slices shrink alike; no text and no language is left out for its length.
The sample that reaches the driver has SAMPLE bytes for each language.
Scoring reads whole texts of all rows, a few hundred KB at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import fold, settle, table
from inkstone.llm.wordhash import LOWER, texts

ORDER = 4
PER_LANGUAGE = 400
LONGEST = 50_000
SAMPLE = 8_000_000
#: Bits are divided by this before they become a probability: neighbouring bytes tell much the same.
TEMPER = 8.0
PIECE = 1 << 18

_U = np.uint64
_HASH = _U(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Slots:
    """A hash table from 64-bit keys to 0..n-1, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.shift = _U(64 - max(4, int(2 * max(1, len(keys))).bit_length()))
        n = 1 << (64 - int(self.shift))
        self.keys, self.rows = np.zeros(n + 64, _U), np.full(n + 64, -1, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            if at.max(initial=0) >= len(self.rows):
                self.keys = np.concatenate((self.keys, np.zeros(64, _U)))
                self.rows = np.concatenate((self.rows, np.full(64, -1, np.int32)))
            free = np.flatnonzero(self.rows[at] < 0)
            self.rows[at[free]] = left[free]  # of several for one slot, the last stays
            lost = self.rows[at] != left
            self.keys[at[~lost]] = keys[left[~lost]]
            at, left = at[lost] + 1, left[lost]
            self.probes += 1
        if self.probes + n > len(self.rows):
            self.keys = np.concatenate((self.keys, np.zeros(self.probes, _U)))
            self.rows = np.concatenate((self.rows, np.full(self.probes, -1, np.int32)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where((self.keys[at] == keys), self.rows[at], -1)
        for step in range(1, self.probes):
            left = np.flatnonzero(out < 0)
            # An empty slot ends a search.
            left = left[self.rows[at[left] + step - 1] >= 0]
            if not len(left):
                break
            hit = left[(self.keys[at[left] + step] == keys[left])]
            out[hit] = self.rows[at[hit] + step]
        return out


def _mask(k: int) -> np.uint64:
    """Selects a gram of order k: k bytes of context and the byte itself."""
    return _U((1 << (8 * (k + 1))) - 1)


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last ORDER + 1 bytes at each byte, the byte lowest; before a text come zero bytes."""
    x = np.zeros(len(data) + ORDER, _U)
    x[ORDER:] = data
    out = np.zeros(len(data), _U)
    for k in range(ORDER, -1, -1):
        out = (out << _U(8)) | x[ORDER - k : ORDER - k + len(data)]
    for k in range(ORDER):  # what reaches back beyond the text's start
        at = offsets[:-1] + k
        at = at[at < offsets[1:]]
        out[at] &= _mask(k)
    return out


class Model:
    """Merged context trees of the languages `langs`."""

    def __init__(self, samples: dict[str, tuple[np.ndarray, np.ndarray]]):
        """samples: by language, the bytes and offsets of its texts."""
        self.langs = sorted(samples)
        n = len(self.langs)
        grams = [windows(LOWER[data], offsets) for data, offsets in (samples[x] for x in self.langs)]
        self.cost: list[np.ndarray] = []  # by order: gram x language
        self.escape: list[np.ndarray] = []  # by order: context x language, 0 where the context is unknown
        self.grams: list[Slots] = []
        self.contexts: list[Slots] = []
        for k in range(ORDER + 1):
            own = [np.unique(g & _mask(k), return_counts=True) for g in grams]
            keys = np.unique(np.concatenate([g for g, _ in own]))
            heads = np.unique(keys >> _U(8))
            cost, escape = np.zeros((len(keys), n)), np.zeros((len(heads), n))
            below = self.lengths(keys & _mask(k - 1), k - 1) if k else np.full((len(keys), n), 8.0)
            head = np.searchsorted(heads, keys >> _U(8))
            for i, (g, count) in enumerate(own):
                at = np.searchsorted(keys, g)
                total, kinds = np.zeros(len(heads)), np.zeros(len(heads))
                np.add.at(total, head[at], count)
                np.add.at(kinds, head[at], 1)
                known = total > 0
                escape[known, i] = np.log2((total + kinds)[known] / kinds[known])
                cost[:, i] = escape[head, i] + below[:, i]
                cost[at, i] = np.log2((total + kinds)[head[at]] / count)
            self.cost.append(cost.astype(np.float32))
            self.escape.append(np.vstack((escape, np.zeros((1, n)))).astype(np.float32))
            self.grams.append(Slots(keys))
            self.contexts.append(Slots(heads))

    def lengths(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Bits of each gram's last byte in every language, grams of order k."""
        if k < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        row = self.grams[k].find(grams)
        out = self.cost[k][row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            # -1, for an unknown context, is the last row: no escape.
            g = grams[miss]
            out[miss] = self.escape[k][self.contexts[k].find(g >> _U(8))] + self.lengths(g & _mask(k - 1) if k else g, k - 1)
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in every language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        data = LOWER[data]
        for lo in range(0, len(data), PIECE):
            hi = min(len(data), lo + PIECE)
            # A piece takes the bytes before it along, as contexts.
            first = int(np.searchsorted(offsets, lo, "right")) - 1
            back = max(int(offsets[first]), lo - ORDER)
            last = int(np.searchsorted(offsets, hi, "left"))
            cuts = np.clip(offsets[first : last + 1], back, hi) - back
            long = self.lengths(windows(data[back:hi], cuts)[lo - back :])
            starts = np.maximum(cuts[:-1] - (lo - back), 0)
            some = np.flatnonzero(np.minimum(cuts[1:], hi - back) - np.maximum(cuts[:-1], lo - back) > 0)
            out[first + some] += np.add.reduceat(long, starts[some], axis=0, dtype=np.float64)
        return out


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def train(docs: DataFrame, test_fold: tuple[int, int] | None = (4, 2), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The model of docs' languages, or None where no text has one."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    if test_fold:
        rows = rows.where(fold(doc_id, test_fold[0]) != test_fold[1])
    rows = rows.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    size = F.octet_length("text") * F.least(F.lit(1.0), LONGEST / F.length("text"))
    # By language, the share of its documents and the part of a slice that are taken; a table like any other.
    counts = settle(rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")))
    if counts.isEmpty():
        return None
    share = F.least(F.lit(1.0), PER_LANGUAGE / F.col("n"))
    part = F.least(F.lit(1.0), SAMPLE / (F.col("bytes") * share))
    # A language of few documents may lose all of them to no chance: its rate is 1.
    found = rows.join(counts.select("lang", (share * (1 << 30)).cast("long").alias("rate"), part.alias("part")), "lang")
    # Drawn by id and text, so an id that many rows share stands for none of them; equal rows count once, and what is drawn has a bound.
    found = found.withColumn("draw", F.xxhash64("id", "text", F.lit(8))).where(F.pmod("draw", F.lit(1 << 30)) < F.col("rate"))
    found = found.groupBy("lang", "id", "draw").agg(F.first("text").alias("text"), F.first("part").alias("part"))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= 2 * PER_LANGUAGE)
    length = F.ceil(F.least(F.length("text"), F.lit(LONGEST)) * F.col("part")).cast("int")
    start = F.pmod(F.xxhash64("draw", F.lit(9)), F.length("text") - length + 1).cast("int") + 1
    found = found.select("lang", F.substring("text", start, length).alias("text")).orderBy("lang").toArrow()
    names = found["lang"].to_pylist()
    samples = {}
    for name in sorted(set(names)):
        column = pa.array([t for t, x in zip(found["text"].to_pylist(), names) if x == name], pa.large_string())
        samples[name] = texts(column)
    return Model(samples) if samples else None


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of docs.

    score is the language's share of 2 ** (-bits / TEMPER) over all languages.  Null and
    letterless texts, and all texts without a model, are `und` with score 0.  Of languages
    that code a text equally short the first by name is given.
    """

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            found = _lettered(data, offsets) if model else np.zeros(batch.num_rows, bool)
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if found.any():
                bits = model.bits(data, offsets)
                best = bits.argmin(1)
                share = 1 / np.exp2(-(bits - bits.min(1, keepdims=True)) / TEMPER).sum(1)
                names[found] = np.array(model.langs, object)[best[found]]
                score[found] = share[found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Query: the language of every document, learned outside fold 2 of 4.

    Null, empty and letterless texts are `und`; very long ones are scored whole.  Repeated
    rows and null ids are returned as they come; other columns are not read; an empty table
    gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
