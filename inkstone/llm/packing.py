"""Token ids packed into rows of a fixed length: best-fit-decreasing with a segment tree.

Texts become ids of a public byte-level vocabulary, so decoding gives back their bytes,
and an end mark closes each.  Documents longer than a row are cut into pieces, nothing is
dropped.  Pieces are packed longest first, each into the row with the least room that still
holds it; a segment tree over the amounts of room finds it in log(row length) steps.

A task packs its pieces in windows of WINDOW tokens, so memory does not follow the size of
a partition, nothing is shuffled, and a lost task repeats the same rows.  Only the last
rows of a window stay partly empty; a smaller window, which is a parameter, leaves more of
them.  Rows depend on how the input is split, their tokens don't.  The vocabulary file is
read once on the driver, checked to be under VOCABULARY bytes and sent along with the tasks.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import table

LENGTH = 2048
WINDOW = 4_000_000
VOCABULARY = 16_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value of the vocabulary: how text is cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

SCHEMA = "pack_id string, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, starts array<long>"


class Rooms:
    """Open rows by the room they have left: a segment tree over 0..length that counts rows."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        at = self.size + room
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least `need`, with that room; it is taken out."""
        at = self.size + need
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.tree[at] -= 1
            at >>= 1
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices into sizes, none over length in sum; sizes are 1..length."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if found := rooms.take(sizes[i]):
            row, room = found
        else:
            row, room = len(rows), length
            rows.append([])
        rows[row].append(i)
        rooms.add(room - sizes[i], row)
    return rows


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(spark: SparkSession, path: str = TOKENIZER) -> bytes:
    """The bytes of a vocabulary file: a path of the driver's machine, or a URL that Spark reads; executors need no file."""
    if "://" in path:
        found = spark.read.format("binaryFile").load(path).select("length", "content").head()
        size, content = found.length, found.content
    else:
        with open(path, "rb") as file:
            content = file.read(VOCABULARY + 1)
        size = len(content)
    if size > VOCABULARY:
        raise ValueError(f"{path} has {size} bytes; {VOCABULARY} are allowed")
    return bytes(content)


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Packed rows of docs' tokens.

    ids: `length` little-endian 16-bit ids (32-bit for vocabularies beyond 65,535), the row
    of the id matrix, filled up with the end mark; n_tokens of them count.  cu_seqlens:
    cumulative lengths of the row's segments from 0; resets: where positions start again at
    0; doc_ids and starts: each segment's document and its place in the document's tokens.
    pack_id names a row by its first segment.  A null text has no segment, an empty one
    only its end mark; rows with a null or repeated id are packed as they come; other
    columns are not read; an empty table gives an empty result.
    """
    words = vocabulary(docs.sparkSession, tokenizer)
    end = words.count(b"\n") + (not words.endswith(b"\n"))
    kind = np.dtype("<u2") if end <= 65_535 else np.dtype("<u4")

    def rows(pieces: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
        out = []
        for members in best_fit([len(x) for _, _, x in pieces], length):
            ids = np.full(length, end, dtype=kind)
            cuts = [0]
            for i in members:
                piece = pieces[i][2]
                ids[cuts[-1] : cuts[-1] + len(piece)] = piece
                cuts.append(cuts[-1] + len(piece))
            first = pieces[members[0]]
            out.append((f"{first[0]}:{first[1]}", cuts[-1], len(members), ids.tobytes(), cuts, cuts[:-1], [pieces[i][0] for i in members], [pieces[i][1] for i in members]))
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ("pack_id", "n_tokens", "n_segments", "ids", "cu_seqlens", "resets", "doc_ids", "starts")
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    def run(batches):
        encode = encoding(words).encode_to_numpy
        pieces, held = [], 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (value := value.as_py()) is None:
                    continue
                tokens = np.append(encode(value, disallowed_special=()), end).astype(kind)
                for at in range(0, len(tokens), length):
                    pieces.append((key, at, tokens[at : at + length]))
                held += len(tokens)
                if held >= window:
                    yield rows(pieces)
                    pieces, held = [], 0
        if pieces:
            yield rows(pieces)

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """The packed rows as a Parquet table: one binary row of the id matrix each, with its segment lengths and resets."""
    packed.write.mode("overwrite").parquet(path)


def read_matrix(rows: list, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Collected packed rows as arrays (ids, positions, segments), each rows x length.

    positions start again at 0 with every segment; segments numbers them from 1, and both
    are 0 in what is filled up.
    """
    kind = np.dtype("<u2") if not rows or len(rows[0]["ids"]) == 2 * length else np.dtype("<u4")
    ids = np.frombuffer(b"".join(r["ids"] for r in rows), kind).reshape(-1, length)
    positions, segments = np.zeros(ids.shape, np.int32), np.zeros(ids.shape, np.int32)
    for i, r in enumerate(rows):
        for k, (a, b) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:]), 1):
            positions[i, a:b], segments[i, a:b] = np.arange(b - a), k
    return ids, positions, segments


def op9_token_packing(spark, sf_dir: str) -> DataFrame:
    """Query: the token ids of every document in rows of 2,048."""
    return pack(table(spark, sf_dir, "documents"))
