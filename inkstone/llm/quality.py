"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has a mean and a covariance of the transformed statistics, the covariance
shrunk towards the pooled one and towards a multiple of the identity.  A document's
score is the difference of the classes' log densities (Mahalanobis distances through
cached Cholesky factors), put on the scale of a probability by a logistic curve fitted
on the same sample.  The model is fitted on the driver from SAMPLE labelled rows at most,
chosen by a hash of the id; statistics and scores cover whole texts of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import fold, table
from inkstone.llm.wordhash import LOWER, hash_words, texts, word_spans

SAMPLE = 40_000
POOL, IDENTITY = 0.1, 0.02

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 sentence end, 4 comma-like, 5 shouting, 6 symbols, 7 bars and brackets, 8 quotes, 9 blank, 10 line end, 11 beyond ASCII, 12 rest.
_CLASS = np.full(256, 12, np.uint8)
for _n, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"#$%&*@^~+=_", b"|<>[]{}()\\/", b"\"'`-", b" \t", b"\r\n\x0b\x0c", bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _n
_CLASSES = 13
WIDTH = _CLASSES + 9


def _document(kind: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros(WIDTH)
    n, m = len(buf), len(words)
    if n:
        out[:_CLASSES] = np.arcsin(np.sqrt(np.bincount(kind, minlength=_CLASSES) / n))
    out[_CLASSES] = np.log1p(m)
    if m:
        sizes = ends - starts
        _, count = np.unique(words, return_counts=True)
        first, last = kind[starts], kind[ends - 1]
        out[_CLASSES + 1 :] = (
            np.log1p(sizes.mean()),
            np.log1p(sizes.std()),
            np.log1p(sizes.max()),
            np.arcsin(np.sqrt(len(count) / m)),
            np.arcsin(np.sqrt(count.max() / m)),
            np.arcsin(np.sqrt((words[1:] == words[:-1]).mean() if m > 1 else 0.0)),
            np.arcsin(np.sqrt((first == 1).mean())),
            np.arcsin(np.sqrt(((last >= 5) & (last <= 8)).mean())),
        )
    return out


def statistics(column) -> np.ndarray:
    """n x WIDTH transformed statistics of an Arrow string column; null counts as empty, which is all zeros."""
    data, offsets = texts(column)
    out = np.zeros((len(column), WIDTH))
    row = 0
    while row < len(column):  # some MB of whole texts at a time
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 22), "right")) - 1)
        cuts = offsets[row : last + 1] - offsets[row]
        buf = data[offsets[row] : offsets[last]]
        kind = _CLASS[buf]
        starts, ends = word_spans(buf, cuts)
        words = hash_words(LOWER[buf], starts, ends)
        at = np.searchsorted(starts, cuts)
        for i in range(last - row):
            a, b, lo = at[i], at[i + 1], cuts[i]
            out[row + i] = _document(kind[lo : cuts[i + 1]], buf[lo : cuts[i + 1]], starts[a:b] - lo, ends[a:b] - lo, words[a:b])
        row = last
    return out


@dataclass
class Discriminant:
    """A fitted model. With fewer than two classes in the sample, `constant` is every score."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    centres: tuple = ()
    factors: tuple = ()  # inverses of the Cholesky factors
    logs: tuple = ()  # log prior - half the log determinant
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        dens = [log - 0.5 * (((x - c) @ f.T) ** 2).sum(1) for c, f, log in zip(self.centres, self.factors, self.logs)]
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """The model of statistics x and labels y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        return Discriminant(constant=float(y[0]) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    parts = [z[y == k] for k in (0, 1)]
    centres = [p.mean(0) for p in parts]
    scatter = [(p - c).T @ (p - c) for p, c in zip(parts, centres)]
    pooled = sum(scatter) / len(y)
    factors, logs = [], []
    for p, s in zip(parts, scatter):
        # A small class leans more on the pooled covariance.
        pool = POOL + (1 - POOL) * WIDTH / (WIDTH + len(p))
        cov = (1 - pool) * s / len(p) + pool * pooled
        cov = (1 - IDENTITY) * cov + IDENTITY * (np.trace(cov) / WIDTH + 1e-6) * np.eye(WIDTH)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logs.append(np.log(len(p) / len(y)) - np.log(np.diag(low)).sum())
    model = Discriminant(mean, scale, tuple(centres), tuple(factors), tuple(logs))
    # Logistic curve of the margin, by Newton's method with a small ridge that keeps the slope finite.
    m = np.clip(model.margin(x), -200, 200)
    a, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * m).sum() + a, (p - y).sum()])
        h = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    if np.isfinite(a) and np.isfinite(b) and a > 0:
        model.slope, model.shift = float(a), float(b)
    return model


def sampled(labels: DataFrame, most: int) -> DataFrame:
    """About `most` rows of (id, y) at most, by a hash of the id; never more than twice that."""
    n = labels.count()
    if n > most:
        labels = labels.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * most / n)).limit(2 * most)
    return labels


def labelled(labels: DataFrame, value: str, doc_id: str, test_fold: tuple[int, int] | None) -> DataFrame:
    """(id, y) of rows labelled 0 or 1 outside the test fold; a document labelled twice counts once, with the larger label."""
    rows = labels.where(F.col(value).isin(0, 1) & F.col(doc_id).isNotNull())
    if test_fold:
        rows = rows.where(fold(doc_id, test_fold[0]) != test_fold[1])
    return rows.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(value).cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, test_fold: tuple[int, int] | None = (3, 1), doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Discriminant:
    """The model of docs' whole texts and labels.quality; the sample of labels is small by its bound, so it is broadcast."""

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), batch.column(1), batch.column(2)], ["x", "y", "id"])

    wanted = sampled(labelled(labels, "quality", doc_id, test_fold), most)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(wanted), "id")
    # One row for an id, however many documents share it: the sample is bounded in rows as in ids.
    found = rows.select("text", "y", "id").mapInArrow(run, "x binary, y int, id long").groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).orderBy("id").toArrow()
    x = np.frombuffer(b"".join(found["x"].to_pylist())).reshape(-1, WIDTH)
    return fit(x, found["y"].to_numpy().astype(float))


def scores(docs: DataFrame, model: Discriminant, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for every row of docs."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1))))], ["id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, score double")


def accepted(docs: DataFrame, model: Discriminant, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics(batch.column(text))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Query: the quality of every document.

    Learned from labelled rows outside fold 1 of 3.  Null, empty and blank texts are
    scored by their (zero) statistics, very long ones whole.  Repeated rows and null ids are
    returned as they come; without labels every score is 0.5.  Other columns are not read;
    an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold("id", 3) == 1, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
