"""Toxicity: a lexicon trie met by Levenshtein automata, with scores from the words around a hit.

The lexicon is learned: whole words and stems (beginnings that many toxic words share)
that occur in labelled toxic documents and hardly in clean ones.  Support counts distinct
neighbours rather than documents, so copies of one text lend none to their words.
The sample has at most TOXIC and CLEAN documents, chosen by a hash of the id.

A word of a text is run as a Levenshtein automaton (states: position and errors so far)
down the lexicon trie.  One error is allowed in words of FUZZY letters or more, anywhere in
them: a letter replaced, missing or too many, or two neighbours swapped.  Most words never
meet the trie: tables of the bytes with which a word can begin at all, made from the same
errors, turn them away by the million.
Misspelt forms that the clean sample itself contains are exceptions.  Digits and signs end
a word; words that only they join also meet the trie as one, signs as letters, at the same
bound on errors, so that a letter replaced by a sign is found.

A hit is a chance that the document is abuse; quotation marks around it lower the chance,
other hits within WINDOW words raise it.  A document's score joins the chances of all its
hits; where clean documents of the sample have hits too (a stem may also be the start of
harmless words), a logistic curve over the joined chances, the number of hits and their
density, fitted on the sample, takes its place: where at least ten documents of each class
have hits, since fewer tell nothing of three slopes.  Whole texts are scanned, some MB at a time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import fold, settle, table
from inkstone.llm.quality import labelled, sampled
from inkstone.llm.wordhash import LOWER, SPACE, hash_words, texts, word_spans

TOXIC, CLEAN = 3000, 6000
SUPPORT, DOCUMENTS, VARIETY = 6, 8, 0.6  # distinct pairs of neighbours, toxic documents, and the former by the latter
BRANCHES = 3  # letters that follow a stem
ODDS = 12.0  # times likelier in toxic documents
TALLY = 200_000  # terms counted in memory before they go to the exchange
FUZZY = 5
SWAP = 2
STEM = (3, 7)
WINDOW = 8
EXACT, MISSPELT, QUOTED, CLUSTER = 0.6, 0.5, 0.4, 1.3  # one misspelt term alone can decide

#: Bytes between words, as word_spans takes them: all of ASCII but letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def normal(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, blanks for Latin-1 signs and general punctuation; positions stay."""
    out = LOWER[buf]
    if len(buf) < 2:
        return out
    lead, byte = buf[:-1], buf[1:]
    out[1:][(lead == 0xC3) & (byte >= 0x80) & (byte <= 0x9E) & (byte != 0x97)] += 0x20
    signs = np.flatnonzero(lead == 0xC2)
    out[signs] = out[signs + 1] = 0x20
    general = np.flatnonzero((lead == 0xE2) & (byte == 0x80))
    for k in range(3):
        out[np.minimum(general + k, len(buf) - 1)] = 0x20
    return out


def pieces(column, most: int = 1 << 22):
    """(first row, normal bytes, raw bytes, offsets, word starts, word ends, word counts cumulated by row), whole texts at a time."""
    data, offsets = texts(column)
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        cuts = offsets[row : last + 1] - offsets[row]
        raw = data[offsets[row] : offsets[last]]
        buf = normal(raw)
        starts, ends = word_spans(buf, cuts, _BETWEEN)
        yield row, buf, raw, cuts, starts, ends, np.searchsorted(starts, cuts)
        row = last


class Trie:
    """Terms by letter. A node is a dict; its key '' holds (term, stem) of a term that ends there."""

    def __init__(self, terms: dict[str, tuple[bool, float, bool]]):
        """terms: by text, whether it is a stem, the chance that a hit is abuse, whether a misspelling may match."""
        self.root: dict = {}
        for term, (stem, _, loose) in sorted(terms.items()):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, stem, int(loose and len(term) >= FUZZY + stem))

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that word is, or begins with, at the fewest errors (0 or 1); the longest of several."""
        best, n = None, len(word)
        # (node, depth, states): states are the (position in word, errors) of the automaton of word.
        todo = [(self.root, 0, ((0, 0),))]
        while todo:
            node, depth, states = todo.pop()
            if depth and (end := node.get("")):
                most = end[2]
                # A stem has at least one more letter after it.
                ways = [e for i, e in states if i < n and e <= most] if end[1] else [e + n - i for i, e in states if e + n - i <= most]
                if ways and (best is None or (min(ways), -depth) < best[0]):
                    best = ((min(ways), -depth), end[0])
            for c, child in node.items():
                if c and (nxt := self._step(word, n, states, c)):
                    todo.append((child, depth + 1, nxt))
        return best and (best[1], best[0][0])

    @staticmethod
    def _step(word: str, n: int, states: tuple, c: str) -> tuple:
        """The states after letter c of a term; SWAP: the errors of a state that waits for the first of two swapped letters."""
        out: dict[int, int] = {}
        swaps = []
        for i, e in states:
            if e == SWAP:
                if word[i] == c:
                    out[i + 2] = min(1, out.get(i + 2, 9))
                continue
            if i < n and word[i] == c:
                out[i + 1] = min(e, out.get(i + 1, 9))
            if e == 0:
                for j in (i, i + 1):  # c is missing in word, or another letter stands for it
                    if j <= n:
                        out[j] = min(1, out.get(j, 9))
                if i + 1 < n and word[i + 1] == c:  # word has a letter too many, or two swapped ones
                    out[i + 2] = min(1, out.get(i + 2, 9))
                    if word[i] != c:
                        swaps.append((i, SWAP))
        return (*out.items(), *swaps)


def gates(terms: dict[str, tuple[bool, float, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """By a word's first three bytes, and by its second to fourth (24 bits each): whether any term can match it by either."""
    out = np.zeros((2, 256, 256, 256), bool)
    for term, (stem, _, loose) in terms.items():
        letters = list(term[:5])
        if not loose or len(term) < FUZZY + stem:
            p = term.encode() + b"\0\0\0"
            out[0, p[0], p[1], p[2]] = True
            continue
        ways = [letters]
        for k in range(3):  # later errors leave the first three bytes as they are
            ways += [letters[:k] + [None] + letters[k + 1 :], letters[:k] + [None] + letters[k:], letters[:k] + letters[k + 1 :]]
            ways.append(letters[:k] + [letters[k + 1], letters[k]] + letters[k + 2 :])
        for way in ways:
            for spans in _bytes(way):
                # A word that begins with any one byte is looked up by the three that follow.
                late = spans[0] == _ANY[0][0]
                out[(int(late), *(slice(*x) for x in spans[late : late + 3]))] = True
    return out[0].reshape(-1), out[1].reshape(-1)


#: Ranges of the bytes of a letter of one to four bytes.
_ANY = tuple([lead, *[(0x80, 0xC0)] * n] for n, lead in enumerate([(0, 0x80), (0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF8)]))


def _bytes(letters: list[str | None]) -> list[list[tuple[int, int]]]:
    """The byte ranges, four at least, of a beginning in which None is any letter."""
    out: list[list[tuple[int, int]]] = [[]]
    for c in letters:
        own = _ANY if c is None else [[(x, x + 1) for x in c.encode()]]
        out = [way + part for way in out for part in (own if len(way) < 4 else [[]])]
    return [way + [(0, 256)] * (4 - len(way)) for way in out]


class Lexicon:
    def __init__(self, terms: dict[str, tuple[bool, float, bool]], exceptions: frozenset[str] = frozenset(), curve: tuple[float, ...] | None = None):
        self.terms, self.exceptions, self.curve = terms, exceptions, curve
        self.trie, self.gates, self.cache = Trie(terms), tuple(map(np.packbits, gates(terms))), {}
        self.longest = max((len(t.encode()) for t in terms), default=0)

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve}

    def __setstate__(self, state):
        self.__init__(**state)

    def look(self, word: str) -> tuple[str, int] | None:
        if word not in self.cache:
            if len(self.cache) > 200_000:  # only saves time
                self.cache.clear()
            found = self.trie.match(word)
            self.cache[word] = None if found and found[1] and word in self.exceptions else found
        return self.cache[word]

    def hits(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray | None = None) -> list[tuple[int, str, int, int]]:
        """(word's index, term, errors, end) of the words that match, and of joined words that do, at their first word; none reaches beyond a cut."""
        if not len(starts) or not self.terms:
            return []
        out = self._found(buf, starts, ends)
        first, last = joined(buf, starts, ends, cuts)
        plain = np.zeros(len(starts) + 1, np.int64)
        plain[[h[0] + 1 for h in out]] = 1
        plain = np.cumsum(plain)
        free = plain[last + 1] == plain[first]  # a joined word of which no part is a hit by itself
        first, last = first[free], last[free]
        # The longest term with one error more does not reach this far.
        tails = np.minimum(ends[last], starts[first] + self.longest + 8)
        for k, term, errors, end in self._found(buf, starts[first], tails):
            word = buf[starts[first[k]] : end].tobytes().decode("utf-8", "replace")
            if any(c < "\x80" and not c.isalpha() for c in word[: len(term)]):  # the sign stands in the term, not behind a stem
                out.append((int(first[k]), term, errors, end))
        return sorted(out)

    def _found(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, str, int, int]]:
        long = np.flatnonzero(ends - starts >= 3)
        at = starts[long]
        first, second = ((buf[at + k].astype(np.int32) << 16) | (buf[at + k + 1].astype(np.int32) << 8) | buf[np.minimum(at + k + 2, len(buf) - 1)] for k in (0, 1))
        may = lambda gate, three: (gate[three >> 3] >> (7 - (three & 7)).astype(np.uint8)) & 1 == 1
        long = long[may(self.gates[0], first) | may(self.gates[1], second)]
        if not len(long):
            return []
        _, first, which = np.unique(hash_words(buf, starts[long], ends[long]), return_index=True, return_inverse=True)
        found = [self.look(buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")) for i in long[first].tolist()]
        match = np.array([x is not None for x in found])
        some = np.flatnonzero(match[which])
        return [(int(long[i]), *found[which[i]], int(ends[long[i]])) for i in some]


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last word of each row of words with digits or signs but no white space and no cut between them."""
    blank = np.concatenate(([0], np.cumsum(SPACE[buf], dtype=np.int32)))
    gap = (blank[starts[1:]] == blank[ends[:-1]]) & (starts[1:] > ends[:-1])
    if cuts is not None:
        gap &= np.searchsorted(cuts, starts[1:], "right") == np.searchsorted(cuts, starts[:-1], "right")
    edge = np.diff(np.concatenate(([False], gap, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _places(raw: np.ndarray, mark: str) -> np.ndarray:
    """Where a mark stands in raw, in order."""
    sign = mark.encode()
    n = max(0, len(raw) - len(sign) + 1)
    same = raw[:n] == sign[0]
    for k in range(1, len(sign)):
        same &= raw[k : n + k] == sign[k]
    return np.flatnonzero(same)


def _quoted(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each span lies between quotation marks of its line: in the line so far more opened than closed, and one closes after it."""
    lines, out = _places(raw, "\n"), np.zeros(len(starts), bool)
    if not (len(raw) and len(starts)):
        return out
    bounds = np.concatenate(([0], lines + 1, [len(raw) + 1]))
    line = np.searchsorted(bounds, starts, "right") - 1
    first, last = bounds[line], bounds[np.searchsorted(bounds, ends, "right")] - 1

    def before(at):
        """The last place in the line so far, or -1."""
        found = np.concatenate(([-1], at))[np.searchsorted(at, starts)]
        return np.where(found >= first, found, -1)

    after = lambda at: np.searchsorted(at, last) > np.searchsorted(at, ends)
    straight = _places(raw, '"')
    out |= ((np.searchsorted(straight, starts) - np.searchsorted(straight, first)) % 2 == 1) & after(straight)
    for left, right in (("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’")):
        opens, closes = _places(raw, left), _places(raw, right)
        if len(opens) and len(closes):
            out |= (before(opens) > before(closes)) & after(closes)
    return out


def evidence(hits: list[tuple[int, float, bool]], n_words: int) -> tuple[float, float, float]:
    """What the hits of a document, (word's index, chance, quoted), amount to: their joined chance as -log(1 - p), their number and their density, as logarithms."""
    joined = number = 0.0
    for k, (i, chance, quoted) in enumerate(hits):
        near = (k > 0 and i - hits[k - 1][0] <= WINDOW) or (k + 1 < len(hits) and hits[k + 1][0] - i <= WINDOW)
        joined -= np.log1p(-min(0.95, chance * (QUOTED if quoted else CLUSTER if near else 1.0)))
        number += chance * (QUOTED if quoted else 1.0)
    return float(joined), float(np.log1p(number)), float(np.log(1e-3 + number / max(1, n_words)))


def score_of(found: tuple[float, float, float], curve: tuple[float, ...] | None) -> float:
    if curve is None:
        return float(-np.expm1(-found[0]))
    z = curve[0] + sum(c * x for c, x in zip(curve[1:], found))
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def documents(column, lexicon: Lexicon):
    """(row, evidence, floor, hits) of the documents with hits, in an Arrow string column.

    floor: the chance by those hits alone whose terms no clean document of the sample has.
    """
    for row, buf, raw, cuts, starts, ends, at in pieces(column):
        found = lexicon.hits(buf, starts, ends, cuts)
        docs_of = np.searchsorted(at, [h[0] for h in found], "right") - 1
        by: dict[int, list] = {}
        for d, h in zip(docs_of.tolist(), found):
            by.setdefault(d, []).append(h)
        for d, hs in by.items():
            spans = np.array([h[0] for h in hs])
            quoted = _quoted(raw[cuts[d] : cuts[d + 1]], starts[spans] - cuts[d], np.array([h[3] for h in hs]) - cuts[d]).tolist()
            chances = [(i, (MISSPELT if e else EXACT) * lexicon.terms[t][1], q) for (i, t, e, _), q in zip(hs, quoted)]
            sure = evidence([c for c, h in zip(chances, hs) if lexicon.terms[h[1]][2]], 1)
            yield row + d, evidence(chances, int(at[d + 1] - at[d])), score_of(sure, None), [(int(i - at[d]), t, e) for i, t, e, _ in hs]


def scores(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, hits) for every row of docs; hits lists word:term:errors of every hit, comma-joined; without hits the score is 0."""

    def run(batches):
        for batch in batches:
            score, listed = np.zeros(batch.num_rows), [""] * batch.num_rows
            for row, found, floor, hits in documents(batch.column(1), lexicon):
                # A curve fitted on documents with many hits says little of one; a certain hit decides alone.
                score[row] = max(floor, score_of(found, lexicon.curve))
                listed[row] = ",".join(f"{i}:{t}:{e}" for i, t, e in hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(listed, pa.string())], ["id", "score", "hits"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, score double, hits string")


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...] | None:
    """Intercept and slopes of a ridge logistic regression; None unless both classes have some documents with hits."""
    if min((y == 1).sum(), (y == 0).sum()) < 10:
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack((np.ones((len(x), 1)), (x - mean) / scale))
    b, ridge = np.zeros(z.shape[1]), np.diag([1e-6, *[1.0] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * (p * (1 - p) + 1e-9))[:, None]) + ridge, z.T @ (weight * (p - y)) + ridge @ b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    slopes = b[1:] / scale
    return (float(b[0] - (slopes * mean).sum()), *map(float, slopes))


def _words(column):
    """(row, words as text) of an Arrow string column."""
    for row, buf, _, _, starts, ends, at in pieces(column):
        whole = buf.tobytes()
        for d in range(len(at) - 1):
            yield row + d, [whole[starts[i] : ends[i]].decode("utf-8", "replace") for i in range(at[d], at[d + 1])]


def _terms(word: str):
    yield word, False
    for n in range(STEM[0], min(STEM[1], len(word) - 1) + 1):
        yield word[:n], True


def train(docs: DataFrame, labels: DataFrame, test_fold: tuple[int, int] | None = (4, 2), doc_id: str = "doc_id", text: str = "text") -> Lexicon:
    """The lexicon of docs' whole texts and labels.toxic; empty without toxic labels."""
    known = settle(labelled(labels, "toxic", doc_id, test_fold))
    wanted = sampled(known.where("y = 1"), TOXIC).unionByName(sampled(known.where("y = 0"), CLEAN))
    all_of = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sample = settle(rows.join(F.broadcast(wanted), "id").select("text", "y", "id"))

    def contexts(batches):
        for batch in batches:
            out = set()
            for _, words in _words(batch.column(0)):
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    if len(word) >= 3:
                        out.update((*t, f"{before} {after}") for t in _terms(word))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string())], ["term", "stem", "around"])

    support = sample.where("y = 1").select("text").mapInArrow(contexts, "term string, stem boolean, around string")
    support = support.groupBy("term", "stem").agg(F.count_distinct("around").alias("n")).where(F.col("n") >= SUPPORT)
    support = settle(support)

    def counts(batches):
        out: dict[tuple[str, bool], list[int]] = {}

        def rows():
            keys = list(out)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([out[k][0] for k in keys], pa.int64()), pa.array([out[k][1] for k in keys], pa.int64())],
                ["term", "stem", "clean", "toxic"],
            )

        for batch in batches:
            labels_of = batch.column(1).to_pylist()
            for row, words in _words(batch.column(0)):
                for t in {t for w in set(words) if len(w) >= 3 for t in _terms(w)}:
                    out.setdefault(t, [0, 0])[int(labels_of[row])] += 1
                if len(out) > TALLY:
                    yield rows()
                    out.clear()
        yield rows()

    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon({})
    found = sample.mapInArrow(counts, "term string, stem boolean, clean long, toxic long").groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / (clean + 1))
    found = found.where((odds >= ODDS) & (F.col("toxic") >= DOCUMENTS)).join(support, ["term", "stem"])
    # The letters that follow a beginning in any supported term.
    size = F.least(F.lit(STEM[1]), F.length("term") - 1)
    longer = support.where(F.length("term") > STEM[0]).select("term", F.explode(F.sequence(F.lit(STEM[0]), size)).alias("k"))
    after = longer.select(F.expr("substring(term, 1, k)").alias("term"), F.expr("substring(term, k + 1, 1)").alias("next")).groupBy("term").agg(F.count_distinct("next").alias("branches"))
    rows = found.where(F.col("n") >= VARIETY * F.col("toxic")).join(after, "term", "left").where(~F.col("stem") | (F.col("branches") >= BRANCHES)).collect()
    terms = choose({(r.term, r.stem): (r.toxic / toxic, (r.clean + 0.5) / (clean + 1), r.clean == 0) for r in rows})
    lexicon = Lexicon(terms)

    def misspelt(batches):
        for batch in batches:
            out = set()
            for _, buf, _, cuts, starts, ends, _ in pieces(batch.column(0)):
                out.update(buf[starts[i] : end].tobytes().decode("utf-8", "replace") for i, _, e, end in lexicon.hits(buf, starts, ends, cuts) if e)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["word"])

    innocent = sample.where("y = 0").select("text").mapInArrow(misspelt, "word string").distinct().collect()
    lexicon = Lexicon(terms, frozenset(r.word for r in innocent))

    def gathered(batches):
        for batch in batches:
            labels_of = batch.column(1).to_pylist()
            ids = batch.column(2).to_pylist()
            rows = [(*x, labels_of[row], ids[row]) for row, x, *_ in documents(batch.column(0), lexicon)]
            yield pa.RecordBatch.from_arrays([*(pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(4)), pa.array([r[4] for r in rows], pa.int64())], [*"abcy", "id"])

    # One row for an id, however many documents share it.
    each = sample.mapInArrow(gathered, "a double, b double, c double, y double, id long").groupBy("id").agg(F.min(F.struct("a", "b", "c", "y")).alias("x"))
    seen = each.select("x.*").toArrow()
    x, y = np.array([seen[c].to_numpy() for c in "abc"]).T, seen["y"].to_numpy()
    weight = np.where(y == 1, all_of.get(1, 0) / toxic, all_of.get(0, 0) / max(1, clean))
    return Lexicon(terms, lexicon.exceptions, fit_curve(x, y, weight))


def choose(rates: dict[tuple[str, bool], tuple[float, float, bool]]) -> dict[str, tuple[bool, float, bool]]:
    """Terms of the lexicon, from the shares of toxic and clean documents that have each, and whether no clean one does.

    Only stems that BRANCHES letters follow are given.  A stem counts if it reaches
    clearly more toxic documents than any one word that begins with it; of stems that extend one another the longest with the same reach stays.  Words
    under a stem go.
    """
    words = {t: r for (t, stem), r in rates.items() if not stem}
    best: Counter = Counter()
    for w, (toxic, *_) in words.items():
        for n in range(STEM[0], min(STEM[1], len(w)) + 1):
            best[w[:n]] = max(best[w[:n]], toxic)
    stems: dict[str, tuple[float, float, bool]] = {}
    for (t, stem), r in sorted(rates.items(), key=lambda x: (-x[1][0], -len(x[0][0]), x[0][0])):
        if stem and r[0] > 1.3 * best[t] and not any(t.startswith(s) or s.startswith(t) and r[0] < 1.05 * stems[s][0] for s in stems):
            stems = {s: x for s, x in stems.items() if not s.startswith(t)} | {t: r}
    for s in sorted(stems, key=len):  # a stem is replaced by a longer one that reaches as far
        longer = [t for (t, stem), r in rates.items() if stem and t.startswith(s) and r[0] >= 0.97 * stems[s][0]]
        if (t := max(longer, key=len, default=s)) != s:
            stems[t] = rates[t, True]
            del stems[s]
    chance = lambda r: r[0] / (r[0] + r[1])
    out = {t: (False, chance(r), r[2]) for t, r in words.items() if not any(t.startswith(s) for s in stems)}
    return out | {s: (True, chance(r), r[2]) for s, r in stems.items()}


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: the toxicity of every document, learned outside fold 2 of 4.

    Null and empty texts score 0; very long ones are scanned whole.  Repeated rows and null
    ids are returned as they come; other columns are not read; without toxic labels every
    score is 0; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold("id", 4) == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "hits")
