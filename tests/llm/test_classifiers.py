"""Held-out accuracy of the learned operators, their parts against plain versions, and edge cases."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import language, quality, toxicity
from inkstone.llm.common import table
from inkstone.llm.wordhash import texts

SF = "/root/testdata/sf0.01"


def labels(spark, column):
    return {r.doc_id: r[column] for r in table(spark, SF, "labels").collect()}


def test_quality_held_out(spark):
    truth = labels(spark, "quality")
    rows = quality.op6_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_statistics_do_not_depend_on_batches():
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab C!.\n9é|") for _ in range(rng.randrange(50))) for _ in range(200)] + [None, ""]
    whole = quality.statistics(pa.array(rows))
    for i, text in enumerate(rows):
        assert np.allclose(whole[i], quality.statistics(pa.array([text], pa.string()))[0])
    assert not whole[-1].any() and not whole[-2].any()


def test_discriminant_against_the_density():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (400, quality.WIDTH)), rng.normal(0.5, 2, (300, quality.WIDTH))])
    y = np.repeat([0.0, 1.0], [400, 300])
    model = quality.fit(x, y)
    z = (x - model.mean) / model.scale
    for k in (0, 1):
        low = np.linalg.inv(model.factors[k])
        cov = low @ low.T
        d = z[:50] - model.centres[k]
        direct = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]
        fast = model.logs[k] - np.log(np.mean(y == k)) - 0.5 * ((d @ model.factors[k].T) ** 2).sum(1)
        assert np.allclose(direct, fast)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, None), (3, ""), (None, "x"), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    assert [r.score for r in quality.scores(docs, model).collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, one, None).constant == 1.0
    assert quality.accepted(docs, quality.train(docs, one, None)).columns == docs.columns
    assert quality.scores(docs.limit(0), model).collect() == []


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    rows = language.op8_language_id(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 200 and np.mean(held) > 0.98


def plain_bits(samples, text):
    """Code length by walking the contexts one byte at a time, with dictionaries."""
    counts = {}
    for s in samples:
        b = bytes(language.ORDER) + s.encode()
        for i in range(language.ORDER, len(b)):
            for k in range(language.ORDER + 1):
                counts.setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                counts[b[i - k : i]][b[i]] += 1
    b, total = bytes(language.ORDER) + text.encode(), 0.0
    for i in range(language.ORDER, len(b)):
        for k in range(language.ORDER, -1, -1):
            own = counts.get(b[i - k : i])
            if own is None:
                continue
            n, d = sum(own.values()), len(own)
            if b[i] in own:
                total -= np.log2(own[b[i]] / (n + d))
                break
            total -= np.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact(monkeypatch):
    rng = random.Random(4)
    make = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    own = {"xx": make("abc "), "yy": make("bcdé ")}
    model = language.Model({k: texts(pa.array(v)) for k, v in own.items()})
    tests = ["", *make("abcdé zq")]
    monkeypatch.setattr(language, "PIECE", 7)  # pieces that cut texts
    found = model.bits(*texts(pa.array(tests)))
    for i, t in enumerate(tests):
        assert np.allclose(found[i], [plain_bits(own[k], t) for k in ("xx", "yy")], rtol=1e-5), t


def test_slots_find_what_they_hold():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**40, 5000, dtype=np.uint64))
    slots = language.Slots(keys)
    assert (slots.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 2**40, 5000, dtype=np.uint64), keys)
    assert (slots.find(other) == -1).all()


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "abc", "xx"), (2, None, "xx"), (3, "123 .", None), (None, "abd", "yy"), (5, "中文", None)], "doc_id long, text string, lang string")
    model = language.train(docs, None)
    assert {r.id: r.lang_pred for r in language.identify(docs.where("doc_id > 0"), model).collect()}[1] == "xx"
    got = {r.id: (r.lang_pred, r.score > 0) for r in language.identify(docs, model).collect()}
    assert got[2] == got[3] == ("und", False) and got[5][1]
    none = docs.where("lang = 'zz'")
    assert language.train(none) is None
    assert [r.lang_pred for r in language.identify(docs.limit(1), None).collect()] == ["und"]
    assert language.identify(none, model).collect() == []


def test_languages_of_long_texts_only(spark, monkeypatch):
    """A language, or a whole table, of texts longer than the slice is learned from slices."""
    rng = random.Random(3)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, make("abc ", 300), "xx") for i in range(20)] + [(100 + i, make("défg ", language.LONGEST + 1 + i), "yy") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for part in (docs, docs.where("lang = 'yy'")):
        model = language.train(part, None)
        assert model.langs == sorted({r.lang for r in part.collect()})
        assert all(r.lang_pred == ("xx" if r.id < 100 else "yy") for r in language.identify(part, model).collect())
    taken = []
    monkeypatch.setattr(language, "SAMPLE", 10_000)
    monkeypatch.setattr(language, "texts", lambda c: taken.append(c) or texts(c))
    assert language.train(docs, None).langs == ["xx", "yy"]
    assert [len(c) for c in taken] == [20, 4] and all(5_000 < sum(len(t.encode()) for t in c.to_pylist()) < 11_000 for c in taken)


def test_toxicity_held_out(spark):
    truth = labels(spark, "toxic")
    rows = toxicity.op10_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.9
    assert all(t for p, t in held if p)


def distance(a, b):
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        swap = d(i - 2, j - 2) + 1 if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else 9
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]), swap)

    return d(len(a), len(b))


TERMS = {"idiot": (False, 1.0, True), "scum": (False, 1.0, True), "worthless": (False, 1.0, True), "lowei": (True, 0.9, False), "lostra": (True, 1.0, True), "équipe": (False, 1.0, True)}


def test_trie_matches_plain_distances():
    rng = random.Random(9)
    lexicon = toxicity.Lexicon(TERMS)
    words = []
    for t in [*TERMS, "loweient", "lostrachen"]:
        for _ in range(150):
            w = list(t)
            if rng.random() < 0.3:
                k = rng.randrange(len(w) - 1)
                w[k : k + 2] = w[k + 1], w[k]
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = [rng.choice("aeiotszé")] * rng.randrange(2)
            words.append("".join(w) + rng.choice(["", "", "e", "heit"]))
    for w in words:
        if len(w) < 1:
            continue
        best = []
        for t, (stem, _, loose) in TERMS.items():
            most = 1 if loose and len(t) >= toxicity.FUZZY + stem else 0
            e = min((distance(t, w[:n]) for n in range(len(w))), default=9) if stem else distance(t, w)
            if e <= most:
                best.append((e, -len(t), t))
        found = lexicon.trie.match(w)
        assert (found and found[1]) == (min(best)[0] if best else None), (w, found, best)
        if found and len(w.encode()) >= 3:  # the gate lets every match through
            buf = np.frombuffer(w.encode(), np.uint8)
            assert lexicon.hits(buf, np.array([0]), np.array([len(buf)])), w


def test_every_single_error_is_found():
    """Made-up terms of eight letters: each replaced, missing, added or swapped letter, the first one too, is met through the gates."""
    rng = random.Random(12)
    terms = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(8)) for _ in range(50)]
    lexicon, missed = toxicity.Lexicon({t: (False, 1.0, True) for t in terms}), []
    for t in terms:
        for k in range(8):
            c = rng.choice("abcxyzü")
            for w in (t[:k] + c + t[k + 1 :], t[:k] + t[k + 1 :], t[:k] + c + t[k:], t[:k] + t[k + 1 : k + 2] + t[k : k + 1] + t[k + 2 :]):
                buf = np.frombuffer(w.encode(), np.uint8)
                missed += [] if lexicon.hits(buf, np.array([0]), np.array([len(buf)])) else [(t, w)]
    assert not missed


def test_quotation_lowers_a_score(spark):
    lexicon = toxicity.Lexicon(TERMS)
    rows = ["You are an idiot and scum", 'He wrote "idiot" there', "He said “what an idiot” once", "You idiott", "nothing here", None, "", "IDIOT!", "loweiheit", "lowei", "idiots idiotic " * 50_000]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(rows)], "doc_id long, text string, hits string")
    s = {r.id: r.score for r in toxicity.scores(df, lexicon).collect()}
    assert s[0] > s[7] > s[3] >= 0.3 > s[1] > 0 and s[2] == pytest.approx(s[1]) and s[4] == s[5] == s[6] == s[9] == 0 and s[8] > 0.3
    assert toxicity.scores(df.limit(0), lexicon).collect() == []


def plain_quoted(raw, start, end):
    """Quotation by cutting the line of a span out of the whole text."""
    before, after = raw[:start].rpartition(b"\n")[2], raw[end:].partition(b"\n")[0]
    pairs = [(x.encode(), y.encode()) for x, y in ("“”", "«»", "„“", "‘’")]
    return before.count(b'"') % 2 == 1 and b'"' in after or any(before.rfind(x) > before.rfind(y) and y in after for x, y in pairs)


def test_quotation_reads_whole_lines(spark):
    rng = random.Random(5)
    for n in range(300):
        raw = "".join(rng.choice([" idiot ", " w ", '"', "“", "”", "«", "»", "„", "‘", "’", "\n", "é"]) for _ in range(rng.randrange(40))).encode()
        at = [k for k in range(len(raw)) if raw.startswith(b"idiot", k)]
        found = toxicity._quoted(np.frombuffer(raw, np.uint8), np.array(at, int), np.array(at, int) + 5)
        assert found.tolist() == [plain_quoted(raw, k, k + 5) for k in at], raw
    far, lexicon = "plain words " * 400, toxicity.Lexicon(TERMS)
    # After a quotation that began long before; deep inside a long one.
    rows = [f'"{far}" {far[:1200]} you idiot {far[:600]} "yes"', f'He wrote "{far} you idiot {far}" there', "you idiot", 'He wrote "idiot" there']
    s = {r.id: r.score for r in toxicity.scores(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), lexicon).collect()}
    assert s[0] == pytest.approx(s[2]) and s[1] == pytest.approx(s[3]) and s[1] < s[0]


def test_letters_replaced_by_digits_and_signs(spark):
    lexicon = toxicity.Lexicon(TERMS, frozenset(["wort*less"]))
    rows = [f"you {w} there" for w in ("id1ot", "(ID!OT),", "i-diot", "w0rthless", "st*ff", "id10t", "wort*less", "lostr4chen", "loxtra-foo", "idi ot", "id\not", "idiot-like", "a/b/idiot")]
    rows += ["id1", "ot", "id-" + "x" * 100_000, "x" * 100 + "-y", "ab-c" * 20_000]
    got = {r.id: r.hits for r in toxicity.scores(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1), lexicon).collect()}
    assert [got[k] for k in range(len(rows))] == ["1:idiot:1"] * 2 + ["2:idiot:1"] + ["1:worthless:1"] + [""] * 3 + ["1:lostra:1"] + [""] * 3 + ["1:idiot:0", "3:idiot:0"] + [""] * 5


def test_rare_abuse_among_many_common_words(spark):
    """More than 50,000 (term, stem) pairs are commoner in toxic documents than the abuse."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(15_000)]
    rows = []
    for y in (1, 0):
        texts_of = [[] for _ in range(40)]
        for w in words:
            for k in rng.sample(range(40), 14):
                texts_of[k].append(w)
        for own in texts_of:
            rng.shuffle(own)
        for k in range(10 * y):
            texts_of[k].insert(100, "vilest")
        rows += [(100 * y + k, " ".join(own), y) for k, own in enumerate(texts_of)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), None)
    assert list(lexicon.terms) == ["vilest"]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, none).terms == {}


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "the cat and the dog " * 200_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    model = language.Model({"en": texts(pa.array(["the cat and the dog"])), "xx": texts(pa.array(["xxxx"]))})
    assert [r.lang_pred for r in language.identify(df, model).orderBy("id").collect()] == ["en", "xx"]
    assert [r.score for r in quality.scores(df, quality.fit(np.zeros((0, quality.WIDTH)), np.zeros(0))).collect()] == [0.5, 0.5]
    assert np.isfinite(quality.statistics(pa.array([r.text for r in df.collect()]))).all()


def test_one_misspelt_term_decides(spark):
    """With and without a curve, however little the curve makes of a single hit; a quoted one does not."""
    filler = " ".join(f"wort{i}" for i in range(400))
    texts = [f"{filler} du {w} {filler}" for w in ("worthles", "w0rthless", "wotrhless", "wortthless", "warthless")] + [f'{filler} he said "worthles" {filler}', filler]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for curve in (None, (-20.0, 0.1, 0.1, 0.1)):
        found = {r.id: r.score for r in toxicity.scores(df, toxicity.Lexicon({"worthless": (False, 0.99, True)}, frozenset(), curve)).collect()}
        assert [found[i] >= 0.3 for i in range(len(texts))] == [True] * 5 + [False] * 2


@pytest.mark.parametrize("ids", [[7], [1, 3], [5, 11]])
def test_languages_of_rows_that_share_an_id(spark, ids):
    """No language is lost, and what is drawn keeps its bound, whatever ids the rows share."""
    english, french = "the weather is fine and the ship leaves harbour number {}", "le temps est beau et le navire quitte le port numéro {}"
    rows = [(ids[0], english.format(i), "en") for i in range(900)] + [(ids[-1], french.format(i), "fr") for i in range(3000)] + [(ids[0], english.format(0), "en")] * 500
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), None)
    assert model.langs == ["en", "fr"]
    got = language.identify(spark.createDataFrame([(1, "the ship is fine"), (2, "le navire est beau")], "doc_id long, text string"), model)
    assert {r.id: r.lang_pred for r in got.collect()} == {1: "en", 2: "fr"}
