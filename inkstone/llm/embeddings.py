"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components.

Each table takes the signs of `bits` random projections as a vector's code.  Two
vectors at angle t share a table's code with probability (1 - t/pi)**bits.  bits follows
the number of vectors, so that buckets of unrelated vectors stay small at any size, and
the number of tables follows from bits, so that a pair exactly at the threshold is missed
in all tables with probability MISS at most; closer pairs far less often.

Equal vectors of one label are one vertex with a count.  Buckets are compared in blocks,
by matrix products; a task holds two blocks.  A pair counts in the first table in which
its codes agree, so each pair is counted once however many tables it shares, and tasks
emit counts by vector and spanning edges, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from inkstone.llm.common import components, settle, table
from inkstone.llm.linking import Forest

MISS = 1e-3
BLOCK = 2048  # vectors of a block
SMALL = 16  # vectors of a bucket that is compared together with others
SEED = 11


def plan(n: int, cosine: float) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(30, max(12, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def _codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """n x tables codes of unit vectors; the planes depend on the dimension alone."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.uint32))).sum(-1, dtype=np.uint32)


def _small(bits: int):
    """The type of a code: what is sent to a task is no larger than it must be."""
    return np.uint16 if bits <= 16 else np.uint32


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _hashed(bits: int, tables: int, kind):
    """(id, label, dim, vector as stored, codes, table codes) of the classes."""
    small = _small(bits)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column("vector")
                sizes = lists.value_lengths().to_numpy()
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    part = batch.take(pa.array(rows))
                    flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    unit = _unit(flat.reshape(len(rows), dim))
                    codes = _codes(unit, bits, tables)
                    where = (np.arange(tables, dtype=np.int64) << 32) | codes
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("label"), pa.array(np.full(len(rows), dim, np.int64)), part.column("copies"), pa.array([x.tobytes() for x in flat.astype(kind).reshape(len(rows), dim)], pa.binary()), pa.array([x.tobytes() for x in codes.astype(small)], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, where.size + 1, tables, dtype=np.int32)), pa.array(where.reshape(-1)))],
                        ["id", "label", "dim", "copies", "raw", "codes", "places"],
                    )

    return run


def _fixed(column: pa.ChunkedArray, kind) -> np.ndarray:
    """A column of binary values of one length as a matrix."""
    column = column.combine_chunks()
    column = (column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def _counted(cosine: float, tables: int, bits: int, kind):
    """Per bucket and pair of blocks: (a, null, links of a) and spanning edges (a, b, null)."""
    code = _small(bits)

    def bucket(rows: pa.Table):
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        place, left, right = rows["bucket"][0].as_py() & 1023, rows["_i"][0].as_py(), rows["_j"][0].as_py()
        unit = _unit(_fixed(rows["raw"], kind).astype(np.float64))
        codes = _fixed(rows["codes"], code)
        own = rows["_block"].to_numpy()
        a = np.flatnonzero(own == left)
        b = a if left == right else np.flatnonzero(own == right)
        links = np.zeros(len(ids), np.int64)
        trees = Forest(len(ids))
        step = max(1, (1 << 20) // max(1, len(b)))
        for at in range(0, len(a), step):
            i = a[at : at + step]
            x, y = np.nonzero(unit[i] @ unit[b].T >= cosine - 1e-9)
            x, y = i[x], b[y]
            x, y = (x[x < y], y[x < y]) if left == right else (x, y)
            for lo in range(0, len(x), 1 << 15):
                p, q = x[lo : lo + (1 << 15)], y[lo : lo + (1 << 15)]
                same = codes[p] == codes[q]
                keep = (np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine) & (same.argmax(1) == place)
                p, q = p[keep], q[keep]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                new = trees.up[p] != trees.up[q]
                for u, v in zip(p[new].tolist(), q[new].tolist()):
                    trees.join(u, v)
                trees.roots()
        roots = trees.roots()
        moved = np.flatnonzero(roots != np.arange(len(ids)))
        return emitted(ids, links, np.stack([ids[moved], ids[roots[moved]]], 1))

    def small(rows: pa.Table, cuts: np.ndarray):
        """All buckets of a few rows at once: one pass for each distance between two rows of a bucket."""
        ids, copies, place = rows["id"].to_numpy(), rows["copies"].to_numpy(), rows["bucket"].to_numpy() & 1023
        unit, codes = _unit(_fixed(rows["raw"], kind).astype(np.float64)), _fixed(rows["codes"], code)
        which = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        links, edges = np.zeros(len(ids), np.int64), [np.empty((0, 2), np.int64)]
        for step in range(1, int(np.diff(cuts).max(initial=0))):
            p = np.flatnonzero(which[:-step] == which[step:])
            p = p[np.einsum("ij,ij->i", unit[p], unit[p + step]) >= cosine]
            p = p[(codes[p] == codes[p + step]).argmax(1) == place[p]]
            np.add.at(links, p, copies[p + step])
            np.add.at(links, p + step, copies[p])
            edges.append(np.stack([ids[p], ids[p + step]], 1))
        return emitted(ids, links, np.concatenate(edges))

    def emitted(ids: np.ndarray, links: np.ndarray, edges: np.ndarray):
        some = np.flatnonzero(links)
        if not len(some):
            return None
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((ids[some], edges[:, 0]))), pa.concat_arrays([none(len(some)), pa.array(edges[:, 1])]), pa.concat_arrays([pa.array(links[some]), none(len(edges))])],
            ["a", "b", "links"],
        )

    keys = ["bucket", "dim", "_i", "_j"]

    def whole(rows: pa.Table, cuts: np.ndarray):
        """Buckets between cuts, all of them complete."""
        sizes = np.diff(cuts)
        few = (sizes <= SMALL) & (rows["_i"].to_numpy() == rows["_j"].to_numpy())[cuts[:-1]]
        dims = rows["dim"].to_numpy()[cuts[:-1]]
        for dim in np.unique(dims[few]):
            own = few & (dims == dim) & (sizes > 1)
            if own.any():
                part = rows.filter(pa.array(np.repeat(own, sizes)))
                if (out := small(part, np.concatenate(([0], np.cumsum(sizes[own]))))) is not None:
                    yield out
        for k in np.flatnonzero(~few & (sizes > 1)).tolist():
            if (out := bucket(rows.slice(cuts[k], sizes[k]))) is not None:
                yield out

    def run(batches):
        tail = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows if tail is None else pa.concat_tables([tail, rows])
                change = np.zeros(rows.num_rows, bool)
                for k in keys:
                    col = rows[k].to_numpy()
                    change[1:] |= col[1:] != col[:-1]
                cuts = np.concatenate(([0], np.flatnonzero(change)))
                if len(cuts) > 1:
                    yield from whole(rows.slice(0, cuts[-1]), cuts)
                tail = rows.slice(cuts[-1])
        if tail is not None:
            yield from whole(tail, np.array([0, tail.num_rows]))

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Links and components of vectors of equal label: (id, n_links, component, kept), one row per row.

    Cosines are taken in double precision of the vectors as stored; a pair links at
    `cosine` or more.  Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null label or id, link with nothing; vectors of different
    lengths never link.  n_links counts the other rows linked directly, equal vectors
    included; component is the smallest id reachable, itself included; a null id has a
    null component and kept = false.  Other columns are not read; an empty table gives
    an empty result.
    """
    # Single precision is sent as such; cosines are of the same doubles either way.
    single = isinstance(getattr(vectors.schema[embedding].dataType, "elementType", None), FloatType)
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("vector"), F.col(label).alias("label"))
    # Labels of any type group as they are; a long stands for them in the tasks.
    sound = F.col("vector").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("label", F.xxhash64("label")).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    classes = settle(rows.where("sound").groupBy("label", "h1", "h2", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    bits, tables = plan(classes.count(), cosine)
    hashed = settle(classes.select("id", "label", "copies", "vector").mapInArrow(_hashed(bits, tables, kind), "id long, label long, dim long, copies long, raw binary, codes binary, places array<long>"))
    # A bucket is known by one number; the low bits keep its table.
    bucket = lambda place: ((F.xxhash64("label", place).bitwiseAND(F.lit(-1 << 10))) + F.shiftright(place, 32)).alias("bucket")
    places = hashed.select(F.explode("places").alias("place"), "id", "label", "dim").select(bucket(F.col("place")), "dim", "id")
    sizes = places.groupBy("bucket", "dim").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("long")).drop("_n")
    dealt = places.join(sizes, ["bucket", "dim"]).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    dealt = dealt.withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("_i", F.least("_x", "_block")).withColumn("_j", F.greatest("_x", "_block")).drop("_x", "_blocks")
    dealt = dealt.join(hashed.select("id", "copies", "raw", "codes"), "id")
    keys = ["bucket", "dim", "_i", "_j"]
    found = settle(dealt.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_counted(cosine, tables, bits, kind), "a long, b long, links long"))
    links = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    label_of = components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    known = classes.select("label", "h1", "h2", "copies", F.col("id").alias("rep")).join(links, "rep", "left").join(label_of.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"), F.lit(True).alias("sound"))
    out = rows.select("id", "label", "h1", "h2", "sound").join(known, ["label", "h1", "h2", "sound"], "left")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component"), F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(False)).alias("kept"))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: vectors of one label at cosine 0.93 or more."""
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


#: The same by comparing all pairs of a label; a recursive walk finds the components.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
