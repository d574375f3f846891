"""Base counts and the Kneser-Ney model against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docweave.llm import quality as Q
from docweave.llm.common import prepare

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = SPLIT.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line in seen and SPLIT.search(line):
            dup += 1
        seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + s for i in range(len(words) - 2) for s in range(3) if windows[tuple(words[i:i + 3])] > 1}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside))


def stream_grams(text):
    """The 5-grams of a text's words with a space after each."""
    p = b"    " + b"".join(w.encode() + b" " for w in SPLIT.findall(text))
    return [p[i:i + 5] for i in range(len(p) - 4)]


def brute_model(texts):
    """Log probability function of an interpolated modified Kneser-Ney model, straight from the definition."""
    top = Counter()
    for t in texts:
        top.update(stream_grams(t))
    counts = {5: top}
    for k in range(4, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    stats = {}
    for k, c in counts.items():
        t = Counter(min(n, 5) for n in c.values())
        d = []
        for i, usual in ((1, .5), (2, 1.0), (3, 1.5)):
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else None
            e = i - (i + 1) * y * t[i + 1] / t[i] if t[i] and y is not None else None
            d.append(1 if k > 1 and i == 1 else e if e is not None and 0 < e < i else usual)
        ctx = defaultdict(list)
        for g, n in c.items():
            ctx[g[:-1]].append(n)
        stats[k] = (d, ctx)

    def p(g):
        if not g:
            return 1 / 256
        d, ctx = stats[len(g)]
        ns = ctx.get(g[:-1])
        if not ns:
            return p(g[1:])
        off = lambda n: min(n, d[min(n, 3) - 1])
        n = counts[len(g)].get(g, 0)
        own = (n - off(n)) / sum(ns) if n else 0
        return own + sum(map(off, ns)) / sum(ns) * p(g[1:])
    return p


TEXTS = ["the cat and the dog ran", "a cat sat on the mat\na cat sat on the mat", "dogs and cats are not the same",
         "the the the theatre", "zebra crossing & more"]


@pytest.fixture(scope="module")
def tables(spark):
    prepare(spark)
    docs = spark.createDataFrame([("en", t) for t in TEXTS] + [("fr", "le chat et le chien")], "lang string, text string")
    return Q.kneser_ney(Q.count_grams(docs).cache())


def test_model_equals_the_definition(spark, tables):
    p = brute_model(TEXTS)
    model = Q.hashed_model(tables)
    grams = sorted({g for t in [*TEXTS, "unseen qqq wordz"] for g in stream_grams(t)})
    got = model.log_p(np.array([int.from_bytes(g, "big") for g in grams], np.uint64), "en")
    assert np.allclose(got, [math.log(p(g)) for g in grams], atol=1e-5)
    assert np.allclose(sum(p(b"the " + bytes([b])) for b in range(256)), 1)
    assert model.log_p(np.array([5], np.uint64), "xx")[0] == -math.log(256)


def test_rows_and_both_ways_of_scoring(spark):
    prepare(spark)
    rng = np.random.default_rng(0)
    vocab = [f"{a}{b}" for a in ("ka", "to", "mi", "re") for b in ("n", "s", "la", "ta")]
    rows = [(i, " ".join(rng.choice(vocab, 80)), ("en", "fr", None)[i % 3]) for i in range(120)]
    rows += [(500, "".join(chr(33 + x) for x in rng.integers(0, 90, 4000)).replace("a", " ").replace("Q", " "), "en"),
             (501, None, "en"), (502, "", None), (503, "a b\n\na b\nc\n \n \n", "fr"), (503, "a b\n\na b\nc\n \n \n", "fr"),
             (None, "mi\x0bka to é ka to é ka to", "de"), (505, "kan " * 50_000, "en"),
             (506, "x" * 300_000, "en")]
    docs = spark.createDataFrame([(d, t, l, "k", 1.0) for d, t, l in rows],
                                 "doc_id long, text string, lang string, Text string, score double")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    a = sorted(Q.judge(docs).collect(), key=str)
    b = sorted(Q.judge(docs, max_model=0).collect(), key=str)
    want = sorted(((d, *brute_counts(t)) for d, t, _ in rows), key=str)
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in a), key=str) == want
    for r in a:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if r.base_failed:
            assert not r.kept
    kept = {r.doc_id: r.kept for r in a}
    assert all(kept[i] for i in range(120)) and not kept[500]
    by = {(r.doc_id, r.n_words): r for r in b}
    for r in a:
        other = by[(r.doc_id, r.n_words)]
        assert other.kept == r.kept
        assert (r.score is None) == (other.score is None)
        assert r.score is None or abs(r.score - other.score) < 1e-4


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_gibberish_and_boilerplate_fall_out_on_both_sides(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(1000)]
    often = 1 / np.arange(1, 1001) ** 0.7
    rows = [(i, " ".join(rng.choice(vocab, 400, p=often / often.sum()))) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    rows += [(2000, " ".join("".join(rng.choice(list("aeiouxq"), 6)) for _ in range(120))),
             # the commonest words only, without a window of three words that is found too often
             (2001, " ".join(rng.choice(vocab[:12], 100)))]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    for max_model in (Q.MAX_MODEL, 0):
        got = {r.doc_id: r for r in Q.judge(docs, max_model=max_model).collect()}
        assert not any(r.base_failed for r in got.values())
        assert got[2000].score > got[2000].high and got[2001].score < got[2001].low
        assert not got[2000].kept and not got[2001].kept
        assert all(r.kept for d, r in got.items() if d < 2000)


def test_scores_are_the_cross_entropy_of_whole_texts(spark, monkeypatch):
    """Against the definition, with a text in many parts."""
    prepare(spark)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    p = brute_model(TEXTS)
    want = {i: -sum(math.log(p(g)) for g in stream_grams(t)) / len(stream_grams(t)) for i, t in enumerate(TEXTS)}
    for max_model in (Q.MAX_MODEL, 0):
        got = {r.doc_id: r.score for r in Q.judge(docs, max_model=max_model).collect()}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    words = [t.encode().split() for t in TEXTS] + [[]]
    whole = [g for t in TEXTS for g in stream_grams(t)]
    for step in (1, 7, 1000):
        monkeypatch.setattr(Q, "STEP", step)
        made = list(Q.text_grams(words))
        assert [int(g).to_bytes(5, "big") for gram, _ in made for g in gram] == whole
        assert [int(x) for _, text in made for x in text] == [i for i, t in enumerate(TEXTS) for _ in stream_grams(t)]


def test_copies_count_once(spark):
    prepare(spark)
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("a b", "en")] * 3 + [("a b", "fr"), ("c", "en"), (None, "en"),
                                                                             (None, "en")])] + [(None, "c", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for bound in (10, 0):
        got = Q.without_copies(docs, bound).collect()
        assert sorted((r.lang, r.text or "") for r in got if r.text) == [("en", "a b"), ("en", "c"), ("fr", "a b")]


def test_word_salad_of_known_words_falls_out(spark):
    """The words of clean texts in another order: only n-grams across words tell."""
    prepare(spark)
    rng = np.random.default_rng(7)
    roots = ["".join(rng.choice(list("bcdfglmnprst"), 2)) + v for v in "aeiou" for _ in range(60)]
    endings = {"a": "ra", "e": "lem", "i": "nis", "o": "dor", "u": "tuk"}
    after = {"a": "e", "e": "i", "i": "o", "o": "u", "u": "a"}  # which kind of word follows which

    def prose():
        kind, out = rng.choice(list("aeiou")), []
        for _ in range(400):
            word = rng.choice([r for r in roots if r[-1] == kind])
            out.append(kind + word + endings[kind])
            kind = after[kind] if rng.random() < 0.95 else rng.choice(list("aeiou"))
        return out

    texts = [prose() for _ in range(200)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(1000 + i, " ".join(rng.permutation(w))) for i, w in enumerate(texts[:8])]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    for max_model in (Q.MAX_MODEL, 0):
        got = {r.doc_id: r for r in Q.judge(docs, max_model=max_model).collect()}
        assert not any(r.base_failed for r in got.values())
        assert all(r.kept == (d < 1000) for d, r in got.items())
        assert all(got[1000 + i].score > got[1000 + i].high for i in range(8))


def test_each_table_gets_its_own_scores(spark):
    """Workers are used again: scores of one model must not be taken for another's."""
    prepare(spark)
    rng = np.random.default_rng(4)
    vocab = ["kan", "los", "mit", "ren", "sol", "tag"]

    def table(weights):
        rows = [(i, " ".join(rng.choice(vocab, 60, p=weights)), "en") for i in range(20)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)

    for k in range(3):
        weights = np.roll(np.array([.5, .3, .1, .05, .03, .02]), k)
        docs = table(weights)
        got = {r.doc_id: r.score for r in Q.judge(docs).collect()}
        want = {r.doc_id: r.score for r in Q.judge(docs, max_model=0).collect()}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
