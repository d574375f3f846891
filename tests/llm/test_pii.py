"""PII: base spans against the plain patterns, disclosing terms against their definition."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from docweave.llm import pii as P
from docweave.llm.common import prepare

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def ok(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
            "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def spans(spark, texts):
    prepare(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cols = P.base_spans(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", *[c.alias(k) for k, c in cols.items()]).collect()
    return {r.doc_id: [(k, s.start, s.end) for k in P.PATTERNS for s in r[k]] for r in rows}


FIXED = [
    None, "", "a@b.c", "a@b.c-d_x@y.z", "a@b@c.d.e@f.g", "é x.y+z@mail-1.example.com, ü", "@a.b a@.b a@b.", "..@a.b",
    "1.2.3.4", "300.1.1.1.5.6.7", "1.2.3.4.5.6.7.8", "00001.0255.255.255 256.1.1.1", "1.2.3", "x1.2.3.4y",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111111111111111", "44111111111111111", "4111  1111 1111 1111",
    "x4041894974608795 4041894974608795", "+1 (988) 555-2485 x", "+1 2", "+1...............5", "++49 30 1234567-",
    "+1234567890123456", "+1 (988) 555-2485 +1 (988) 555-2485", "card 4111 1111 1111 1111 1 and +4111 1111 1111",
    "a" * 200_000, "1.1" * 20_000, "a@b" + ".c" * 30_000, "1 " * 50_000, "+1" + " " * 100_000, "x@y.z " * 800,
    "é" * 100 + "🎉 a@b.cd 🎉 1.2.3.4",
]


def test_fixed_texts(spark):
    got = spans(spark, FIXED)
    for i, text in enumerate(FIXED):
        assert got[i] == brute(text), (text or "")[:80]


def test_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("a@.@.-_ 1245+()é\n") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("123 -4") for _ in range(rng.randint(15, 45))) for _ in range(3000)]
    got = spans(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text


def corpus():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, fill(40)) for i in range(60)]
    rows += [(100 + i, f"{fill(12)} Zorblax said: bob@corp.example.com, {fill(12)}") for i in range(4)]
    rows += [(200 + i, f"{fill(10)} zorblax {fill(10)}") for i in range(0)]
    rows += [(300, f"{fill(10)} unseenonce 10.0.0.1 {fill(10)}")] * 3
    rows += [(None, "call +1 (988) 555-2485 now"), (301, None), (302, "")]
    return rows


def test_terms_by_definition(spark):
    prepare(spark)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, terms string")
    out = P.find_pii(docs).collect()
    assert len(out) == len(rows)
    different = {t or "" for _, t in rows}
    n = len(different)
    word = re.compile(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])")
    df, co, dfe, places = {}, {}, {}, {}
    for t in different:
        for w in set(re.split(r"[\W_]+", t.lower())):
            df[w] = df.get(w, 0) + 1
        bases, seen = brute(t), set()
        for k, s, e in bases:
            ent = k + ":" + (t[s:e].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", t[s:e]))
            if ent not in seen:
                seen.add(ent)
                dfe[ent] = dfe.get(ent, 0) + 1
            for m in word.finditer(t):
                inside = (s - P.CONTEXT <= m.start() and m.end() <= s) or (e <= m.start() and m.end() <= e + P.CONTEXT)
                edge = m.end() == e + P.CONTEXT and m.end() < len(t) or m.start() == s - P.CONTEXT and m.start() > 0
                if inside and not edge and not any(a < m.end() and m.start() < b for _, a, b in bases):
                    places.setdefault(t, []).append((m.start(), m.end(), m[0].lower(), ent))
    for t, ws in places.items():
        for pair in {(w, ent) for _, _, w, ent in ws}:
            co[pair] = co.get(pair, 0) + 1
    share = {(w, e): math.log(n * c / (df[w] * dfe[e])) / math.log(n / dfe[e]) for (w, e), c in co.items() if c >= 2}
    want = {t: sorted({(a, b) for a, b, w, e in ws if share.get((w, e), 0) >= P.GENERALISE - 1e-12})
            for t, ws in places.items()}
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t or "")
    assert any("zorblax" in w for w, _ in share)
    for r in out:
        (t,) = texts[r.doc_id]
        assert [(s.start, s.end) for s in r.terms] == want.get(t, [])
        if r.doc_id is not None and 100 <= r.doc_id < 104:
            assert any(t[s.start:s.end] == "Zorblax" for s in r.terms)
        if r.doc_id == 300:  # copies of one text are no evidence
            assert not r.terms


def test_terms_of_classes(spark):
    """No entity is in two texts, but its domain, prefix or kind is."""
    prepare(spark)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, fill(60)) for i in range(300)]
    rows += [(400 + i, f"{fill(5)} zorblax u{i}@acme.example, {fill(5)}") for i in range(8)]
    rows += [(500 + i, f"{fill(5)} glimmer +1 (988) 555-{2000 + i}, {fill(5)}") for i in range(8)]
    rows += [(600, f"{fill(5)} onlyonce u99@acme.example {fill(5)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    found = {r.doc_id: {text[r.doc_id][s.start:s.end] for s in r.terms} for r in P.find_pii(docs).collect()}
    assert all("zorblax" in found[400 + i] and "glimmer" in found[500 + i] for i in range(8))
    assert not any(found[i] for i in range(300))
    assert not any(w in words or w == "onlyonce" for f in found.values() for w in f)
    telling = P.disclosing_terms(docs, P.find_entities(docs)).collect()
    n, df = len(text), 9
    (share,) = [r.share for r in telling if (r.term, r.entity) == ("zorblax", "email/acme.example")]
    assert abs(share - math.log((8 + df / n) / 9 / (df / n)) / math.log(n / df)) < 1e-9


def test_classes(spark):
    names = ["email:a@b.c", "ip:10.20.3.4", "card:4111111111111111", "phone:19885552485"]
    got = spark.createDataFrame([(x,) for x in names], "e string").select(P.classes(F.col("e")).alias("c")).collect()
    assert [r.c for r in got] == [["email:a@b.c", "email", "email/b.c"], ["ip:10.20.3.4", "ip", "ip/10.20"],
                                  ["card:4111111111111111", "card", "card/411111"],
                                  ["phone:19885552485", "phone", "phone/1988"]]


def test_sanitise(spark):
    prepare(spark)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    out = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert out[None] == "call <phone> now" and out[301] == "" and out[5] == dict(corpus())[5]
    assert "<email>" in out[101] and "Zorblax" not in out[101] and "bob@" not in out[101]


def test_query_digest(spark, tmp_path):
    from docweave.llm.catalog import QUERIES
    spark.createDataFrame([(1, "x@y.z and 1.2.3.4")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = QUERIES["op5_pii"](spark, str(tmp_path)).collect()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (1, 1, 0, 0, "email:0:5,ip:10:17")
    assert r.base_sha256 == hashlib.sha256(b"email:0:5,ip:10:17").hexdigest()


def test_empty_table(spark):
    assert P.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
