"""Token counts: the exact count at every prefix of a text, by dynamic programming.

The encoding of a prefix ends in exactly one token that its predecessor allows: the one
before which the rest is encoded as that shorter prefix is.  So the last token and the
count at every prefix follow from those of shorter ones: the tokens that end there are
tried, and one is right if its neighbour and it, encoded together, stay the two of them.
That test needs only the two tokens and is remembered.

What is stored answers budgets (how many tokens have the first p characters?) and cuts
(how many characters fit into b tokens?) with built-in array functions, and no text is
encoded again.  Rows are independent: nothing is shuffled, a task holds one Arrow batch
and tables of a bounded size.  The vocabulary file is read once on the driver, checked to
be under VOCABULARY bytes and sent along with the tasks.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import table
from inkstone.llm.packing import vocabulary

LIMIT = 512
NAME = "byte_bpe_50k.json"
#: Entries of each table of remembered results in a worker; a full one is emptied.
REMEMBERED = 500_000
MASK = (1 << 32) - 1
#: A character beside a letter, a digit, a mark and a blank shows its class.
PROBE = "a{0}1{0}!{0} {0}"
#: Fixed value of byte-level vocabularies: how text is cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Contractions of three characters; the first two of them alone are a mark and a letter.
CONTRACTIONS = ("'re", "'ve", "'ll")


def path(name: str = NAME) -> str:
    """Where the file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Remembered(dict):
    """A function's results by argument, emptied when there are too many."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[key] = self.of(key)
        return found


class Prefixes:
    """Counts under one byte-level vocabulary, given as the bytes of its file."""

    def __init__(self, content: bytes):
        import regex
        from tokenizers import Tokenizer

        model = json.loads(content)
        kinds = (model["model"]["type"], (model["pre_tokenizer"] or {}).get("type"), model["normalizer"])
        if kinds != ("BPE", "ByteLevel", None) or model["pre_tokenizer"]["add_prefix_space"] or model["model"]["dropout"]:
            raise ValueError(f"a byte-level vocabulary without normaliser is needed, not {kinds}")
        # Printable bytes stand for themselves in the file, the others for 256 and up, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        raw = lambda token: bytes(byte[c] for c in token)
        special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else lambda text: [text]
        self.tokens = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.bytes_of = {i: t for t, i in self.tokens.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.merges = {(self.tokens[raw(a)], self.tokens[raw(b)]): (rank, self.tokens[raw(a) + raw(b)]) for rank, (a, b) in enumerate(pairs)}
        #: Every end of a token: its id where it is a token itself, else -1.
        self.tails = {t[k:]: -1 for t in self.tokens for k in range(1, len(t))} | self.tokens
        self.own_pieces = regex.compile(PATTERN).findall
        self.library = Tokenizer.from_str(content.decode()).pre_tokenizer.pre_tokenize_str
        self.byte = byte
        self.agrees = _Remembered(lambda c: [len(x) for x in self.own_pieces(PROBE.format(c))] == [len(x) for x in self._library_pieces(PROBE.format(c))])
        self.size = _Remembered(lambda piece: self.by_byte(piece.encode())[-1])
        self.stays = _Remembered(lambda pair: self.merged(self.bytes_of[pair >> 32] + self.bytes_of[pair & MASK]) == [pair >> 32, pair & MASK])

    def _library_pieces(self, text: str) -> list[str]:
        return [bytes(self.byte[c] for c in x).decode() for x, _ in self.library(text)]

    def pieces(self, text: str) -> list[str]:
        """What is encoded piece by piece; texts with characters that the library puts in another class are cut by it."""
        return self.own_pieces(text) if all(map(self.agrees.__getitem__, set(text))) else self._library_pieces(text)

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of a short piece by merging, rank by rank: what the neighbour test needs."""
        out = [self.tokens[piece[i : i + 1]] for i in range(len(piece))]
        while len(out) > 1:
            rank, new, at = min((*self.merges.get((a, b), (1 << 60, 0)), i) for i, (a, b) in enumerate(zip(out, out[1:])))
            if rank == 1 << 60:
                break
            out[at : at + 2] = [new]
        return out

    def by_byte(self, piece: bytes) -> list[int]:
        """The count at every prefix of a piece, in bytes, from 0."""
        tails, stays = self.tails, self.stays
        counts, last = [0], [0]
        for end in range(1, len(piece) + 1):
            start = end - 1
            own = tails[piece[start:end]]
            while own < 0 or start and not stays[last[start] << 32 | own]:
                start -= 1
                own = tails[piece[start:end]]
            counts.append(counts[start] + 1)
            last.append(own)
        return counts

    def count(self, text: str) -> int:
        """The tokens of a whole text; the strings of special tokens count one."""
        size, pieces = self.size, self.pieces
        return sum(sum(map(size.__getitem__, pieces(part))) if i % 2 == 0 else 1 for i, part in enumerate(self.split_special(text)))

    def _ordinary(self, text: str) -> list[int]:
        """The count at every prefix, in characters, of a text without special tokens."""
        out, base = [0], 0
        at, whole = 0, None
        for piece in self.pieces(text):
            start, at = at, at + len(piece)
            counts = self.by_byte(piece.encode())
            ends, k = [], 0
            for c in piece:
                k += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
                ends.append(counts[k])
            if piece in CONTRACTIONS:
                ends[1] = 2
            out += [base + n for n in ends]
            if whole is not None:
                out[start + 1], whole = whole, None
            # A run of white space leaves its last character to what follows, but not where the prefix ends.
            if at < len(text) and piece.isspace() and self.pieces(text[at - 1 : at + 1])[0] == text[at - 1 : at + 1] and text[at].isspace():
                whole = base + self.by_byte(text[start : at + 1].encode())[-1]
            base += ends[-1]
        return out

    def at_every_prefix(self, text: str) -> list[int]:
        """The count of text[:p] for every p from 0 to its length, as encoding that prefix alone gives it."""
        out, base = [0], 0
        parts = self.split_special(text)
        for i in range(0, len(parts), 2):
            # Cut short, a special token's string is ordinary text and joins what stands before it.
            cut = parts[i + 1][:-1] if i + 1 < len(parts) else ""
            own = self._ordinary(parts[i] + cut)
            out += [base + n for n in own[1:]]
            if i + 1 < len(parts):
                base += own[len(parts[i])] + 1
                out.append(base)
        return out

    def fitting(self, text: str, limit: int) -> tuple[int, int]:
        """(tokens of text, the characters of its longest prefix of at most `limit` tokens)."""
        if len(self.split_special(text)) > 1:
            counts = self.at_every_prefix(text)
            return counts[-1], max((p for p, n in enumerate(counts) if n <= limit), default=0)
        pieces = self.pieces(text)
        sizes = list(map(self.size.__getitem__, pieces))
        if (total := sum(sizes)) <= limit:
            return total, len(text)
        # The prefix ends in the last piece that begins below the limit, or in the white space before it.
        base, at, before, end = 0, 0, (0, 0), 0
        for piece, n in zip(pieces, sizes):
            end = at + len(piece)
            if base + n >= limit:
                break
            before, base, at = (base, at), base + n, end
        base, at = before
        own = self._ordinary(text[at : end + 2])
        return total, at + max((p for p, n in enumerate(own) if base + n <= limit), default=0)


@lru_cache(maxsize=2)
def prefixes_of(content: bytes) -> Prefixes:
    return Prefixes(content)


def counts(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every row.

    fit_chars: the code points of the longest prefix of at most `limit` tokens, all where
    the text fits.  A null text counts as empty: 0 bytes, 0 tokens; texts of any length
    count whole; null and repeated ids come through as they are; other columns are not
    read; an empty table gives an empty result.
    """
    content = vocabulary(docs.sparkSession, tokenizer or path())

    def run(batches):
        model = prefixes_of(content)
        for batch in batches:
            found = [(len(t.encode()), *model.fitting(t, limit)) for t in (x.as_py() or "" for x in batch.column(1))]
            size, n, fit = ([r[i] for r in found] for i in range(3))
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def stored(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts): the count at every prefix from 0 to all code points of the text, to be kept beside it.

    Edge cases are those of counts(); a null or empty text has [0].
    """
    content = vocabulary(docs.sparkSession, tokenizer or path())

    def run(batches):
        model = prefixes_of(content)
        for batch in batches:
            for i in range(batch.num_rows):
                own = model.at_every_prefix(batch.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([own], pa.list_(pa.int32()))], ["doc_id", "counts"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, counts array<int>")


def tokens_of_prefix(counts: Column, chars: Column) -> Column:
    """The tokens of the first `chars` code points; of all where there are fewer; null below 0."""
    return F.when(chars >= 0, F.get(counts, F.least(chars, F.size(counts) - 1)))


def chars_within(counts: Column, budget: Column) -> Column:
    """The code points of the longest prefix of at most `budget` tokens; null for a negative budget."""
    last = F.array_position(F.transform(F.reverse(counts), lambda n: n <= budget), True)
    return F.when(budget >= 0, (F.size(counts) - last).cast("int"))


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: bytes and tokens of every document, whether they exceed 512 tokens, and how many characters fit.

    Null texts count as empty; texts of any length count whole; rows with null or repeated
    ids come through one by one; an empty table gives an empty result.
    """
    return counts(table(spark, sf_dir, "documents"))
