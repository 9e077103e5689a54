"""The learned queries on small tables against plain versions of the whole of each: learning, scoring, deciding."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkstone.llm import quality, toxicity
from inkstone.llm.common import table

#: The smallest table has too few toxic documents for a term of the lexicon.
SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    return docs, labels


# --- quality: statistics character by character, densities with inverse and determinant

CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",;:", "!?", "#$%&*@^~+=_", "|<>[]{}()\\/", "\"'`-", " \t", "\r\n\x0b\x0c"]


def kind(byte):
    return 11 if byte > 127 else next((i for i, c in enumerate(CLASSES) if chr(byte) in c), 12)


def plain_statistics(text):
    data = text.encode()
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", data) if w]
    low = [w.lower() for w in words]
    shares = [sum(kind(b) == k for b in data) / len(data) if data else 0.0 for k in range(13)]
    out = [np.arcsin(np.sqrt(s)) for s in shares] + [np.log1p(len(words))]
    if not words:
        return np.array(out + [0.0] * 8)
    sizes, often = [len(w) for w in words], defaultdict(int)
    for w in low:
        often[w] += 1
    parts = [len(often) / len(words), max(often.values()) / len(words), sum(a == b for a, b in zip(low, low[1:])) / max(1, len(words) - 1), sum(kind(w[0]) == 1 for w in words) / len(words), sum(5 <= kind(w[-1]) <= 8 for w in words) / len(words)]
    return np.array(out + [np.log1p(np.mean(sizes)), np.log1p(np.std(sizes)), np.log1p(max(sizes)), *(np.arcsin(np.sqrt(p)) for p in parts)])


def plain_margins(x, y, every):
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z, out, pooled = (x - mean) / scale, [], 0
    for k in (0, 1):
        pooled = pooled + np.cov(z[y == k].T, bias=True) * (y == k).mean()
    for k in (0, 1):
        own = z[y == k]
        pool = quality.POOL + (1 - quality.POOL) * quality.WIDTH / (quality.WIDTH + len(own))
        cov = (1 - pool) * np.cov(own.T, bias=True) + pool * pooled
        cov = (1 - quality.IDENTITY) * cov + quality.IDENTITY * (np.trace(cov) / quality.WIDTH + 1e-6) * np.eye(quality.WIDTH)
        d = (every - mean) / scale - own.mean(0)
        out.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    return out[1] - out[0]


def test_quality_query(spark):
    docs, labels = rows_of(spark, SF)
    learn = [i for i, r in sorted(labels.items()) if zlib.crc32(str(i).encode()) % 3 != 1 and r.quality in (0, 1) and i in docs]
    every = sorted(docs)
    stats = {i: plain_statistics(docs[i]) for i in every}
    y = np.array([labels[i].quality for i in learn], float)
    margin = plain_margins(np.array([stats[i] for i in learn]), y, np.array([stats[i] for i in every]))
    got = {r.doc_id: r for r in quality.op6_quality_classifier(spark, SF).collect()}
    assert sorted(got) == every
    # The logistic curve of the margins at the labelled rows, by plain gradient descent on the same penalised likelihood.
    m = np.clip(margin[np.isin(every, learn)], -200, 200)
    scores = np.array([got[i].score for i in every])
    inner = (scores > 1e-9) & (scores < 1 - 1e-9)
    slope, shift = np.polyfit(margin[inner], np.log(scores[inner] / (1 - scores[inner])), 1)
    assert np.allclose(slope * margin[inner] + shift, np.log(scores[inner] / (1 - scores[inner])), rtol=1e-4, atol=1e-4)
    p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -40, 40)))
    # At the curve's optimum both derivatives vanish.
    assert abs(((p - y) * m).sum() + slope) < 1e-2 and abs((p - y).sum()) < 1e-2
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


# --- toxicity: the lexicon by counting with dictionaries, hits by plain distances


def words_of(text):
    low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in text)
    low = re.sub("[\u0080-¿ -‿]", " ", low)
    return re.findall(r"[A-Za-z\u0080-\U0010ffff]+", low)


def terms_of(word):
    return [(word, False), *((word[:n], True) for n in range(toxicity.STEM[0], min(toxicity.STEM[1], len(word) - 1) + 1))]


def plain_lexicon(docs, learn):
    around, toxic, clean = defaultdict(set), defaultdict(int), defaultdict(int)
    n = [sum(y == k for _, y in learn) for k in (0, 1)]
    for i, y in learn:
        words = words_of(docs[i])
        if y:
            for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                if len(w) >= 3:
                    for t in terms_of(w):
                        around[t].add((before, after))
        for t in {t for w in set(words) if len(w) >= 3 for t in terms_of(w)}:
            (toxic if y else clean)[t] += 1
    supported = {t for t, a in around.items() if len(a) >= toxicity.SUPPORT}
    follow = defaultdict(set)
    for t, _ in supported:
        for k in range(toxicity.STEM[0], min(toxicity.STEM[1], len(t) - 1) + 1):
            follow[t[:k]].add(t[k])
    rates = {}
    for t in supported:
        odds = (toxic[t] / n[1]) / ((clean[t] + 0.5) / (n[0] + 1))
        if odds >= toxicity.ODDS and toxic[t] >= toxicity.DOCUMENTS and len(around[t]) >= toxicity.VARIETY * toxic[t] and (not t[1] or len(follow[t[0]]) >= toxicity.BRANCHES):
            rates[t] = (toxic[t] / n[1], (clean[t] + 0.5) / (n[0] + 1), clean[t] == 0)
    return toxicity.choose(rates)


def edits(a, b):
    """Distance with swaps, by the whole table."""
    d = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain_match(word, terms):
    best = None
    for t, (stem, _, loose) in terms.items():
        most = int(loose and len(t) >= toxicity.FUZZY + stem)
        ends = range(max(1, len(t) - 1), min(len(word), len(t) + 2)) if stem else [len(word)] if abs(len(word) - len(t)) <= 1 else []
        for n in ends:
            if (e := edits(t, word[:n])) <= most:
                best = min(best or (9, 0, ""), (e, -len(t), t))
    return best


def test_toxicity_query(spark):
    docs, labels = rows_of(spark, MORE)
    learn = [(i, r.toxic) for i, r in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2 and r.toxic in (0, 1) and i in docs]
    terms = plain_lexicon(docs, learn)
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, MORE).collect()}
    lexicon = toxicity.train(table(spark, MORE, "documents"), table(spark, MORE, "labels"))
    assert terms and set(lexicon.terms) == set(terms)
    for t, x in terms.items():
        assert lexicon.terms[t] == (x[0], pytest.approx(x[1]), x[2])
    known = {}
    found = {i: [(k, m) for k, w in enumerate(words_of(text)) if len(w.encode()) >= 3 and (m := known.setdefault(w, plain_match(w, terms)))] for i, text in docs.items()}
    odd = {words_of(docs[i])[k] for i, y in learn if not y for k, m in found[i] if m[0]}
    assert {w for w in lexicon.exceptions if w.isalpha()} == odd
    for i, text in docs.items():
        words = words_of(text)
        want = [f"{k}:{m[2]}:{m[0]}" for k, m in found[i] if not (m[0] and words[k] in odd)]
        # Words that signs join are tested apart; they come on top of these.
        assert [h for h in got[i].hits.split(",") if h in want] == want, i
        assert (got[i].score > 0) == bool(got[i].hits) and got[i].predicted == (got[i].score >= 0.3)
