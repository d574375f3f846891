"""Secret scan against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.llm import secret_scan as S
from docweave.llm.common import prepare

SCHEMA = "doc_id bigint, text string, lang string, source string"
PLAIN = [
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|"""
                          r"""(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))"""
                          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]
LEAST = {"assign": 6, "access": 20, "hex": 24}


def plain_base(text):
    """(start, place of the kind, end, value) by the patterns as they stand."""
    out = []
    for place, (kind, pattern) in enumerate(PLAIN):
        for m in pattern.finditer(text or ""):
            value = m[2] if kind == "assign" else m[0]
            if len(value) >= LEAST[kind]:
                out.append((m.start(), place, m.end(), value))
    return sorted(out)


def random_looking(value, least):
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())
    return len(value) >= 8 and any(c in "0123456789" for c in value) and not value.isdigit() and bits >= least


def brute(rows):
    """doc_id -> (base sha, spans, live, examples), the owners counted over all rows."""
    found, owners = [], {}
    for doc_id, text, lang, source in rows:
        spans = plain_base(text)
        opaque = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]+", text or "")
                  if len(m[0]) >= 20 and random_looking(m[0], 3.5)
                  and all(m.end() <= s or e <= m.start() for s, _, e, _ in spans)]
        spans = sorted(spans + opaque)
        found.append((doc_id, spans))
        for *_, value in spans:
            owners.setdefault(value, set()).add(source or "")
    out = Counter()
    for doc_id, spans in found:
        def text_of(spans):
            return ",".join(f"{('assign', 'access', 'hex', 'opaque')[k]}:{s}:{e}" for s, k, e, _ in spans)

        def judge(value):
            return "example" if len(owners[value]) >= 3 else "live" if random_looking(value, 2.5) else "dummy"

        kept = [s for s in spans if s[1] < 3 or judge(s[3]) == "live"]
        base = [s for s in spans if s[1] < 3]
        out[doc_id, *[sum(s[1] == k for s in base) for k in range(3)],
            hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(kept),
            text_of([s for s in kept if judge(s[3]) == "live"]),
            text_of([s for s in kept if judge(s[3]) == "example"])] += 1
    return out


def scanned(spark, tmp_path, rows, more=()):
    prepare(spark)
    path = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame(rows, SCHEMA).select("*", *more).repartition(3).write.parquet(f"{path}/documents.parquet")
    return Counter(tuple(r) for r in S.op11_secret_scan(spark, path).collect())


def corpus(seed=5):
    rnd = random.Random(seed)

    def key(n, letters="0123456789abcdef"):
        return "".join(rnd.choice(letters) for _ in range(n))

    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    example, own = key(40), [key(40) for _ in range(6)]
    opaque = [key(32, base64) for _ in range(4)]
    makes = [
        lambda: f'token = "{rnd.choice(own)}"', lambda: f"api_key: '{example}'", lambda: "PassWord=changeme",
        lambda: "secret: abc", lambda: f"AKIA{key(16, 'ABCDEFGH0123')}", lambda: "AKIA123", lambda: f"é{key(24)}ü",
        lambda: f"x {rnd.choice(opaque)} y", lambda: key(23), lambda: "apikey=='token:abcdefg", lambda: "été"]
    rows = []
    for i in range(300):
        text = " ".join(rnd.choice([rnd.choice(makes)(), "word", "\n", "ſecret=abcdefgh"]) for _ in range(rnd.randrange(12)))
        rows.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", "d", None])))
    return rows


def test_equals_brute_force(spark, tmp_path):
    rows = corpus()
    out = scanned(spark, tmp_path, rows)
    assert out == brute(rows)
    assert any("opaque" in r[5] for r in out) and any(r[6] for r in out) and any(r[7] for r in out)


def test_edge_cases(spark, tmp_path):
    hot = "token=" + "0123456789abcdef" * 3
    rows = [(1, None, None, None), (2, "", "en", ""), (None, hot, "en", "a"), (3, "x " * 200_000 + hot + " é" * 9, "en", "b"),
            *[(4, hot, "en", "b")] * 50, (5, "password" * 3000, "de", "c"), (6, "0" * 100_000, "de", "c"),
            *[(7, "TOKEN : QqWwEe77RrTtYy", "en", "b")] * 2]
    want = brute(rows)
    assert scanned(spark, tmp_path, rows) == want
    clash = [F.lit("x").alias("row"), F.lit(1).alias("owner"), F.lit(2).alias("spans"), F.lit(3).alias("k1")]
    assert scanned(spark, tmp_path, rows, clash) == want
    empty = S.find_secrets(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "spans"] and empty.count() == 0


def test_owners_and_repositories(spark):
    prepare(spark)
    wide, own = "token=aaaa1111bbbb2222", "token=c3d9e1f7a2b8c4d6"
    rows = [(i, wide, "r1", f"o{i % 3}") for i in range(6)] + [(10 + i, own, f"r{i}", "o1") for i in range(4)]
    out = {r.doc_id: r.spans[0] for r in S.find_secrets(spark.createDataFrame(rows, SCHEMA), repository="lang").collect()}
    assert {(out[i].owners, out[i].repositories, out[i].verdict) for i in range(6)} == {(3, 3, "example")}
    assert {(out[i].owners, out[i].repositories, out[i].verdict) for i in range(10, 14)} == {(1, 4, "live")}


@settings(max_examples=300, deadline=None)
@given(st.text("tokenapi_ykesrTOKN\"' :=AKIA09f.é-K", max_size=120))
def test_base_is_the_plain_patterns(text):
    assert [s for s in S.secret_spans(text) if s[1] < 3] == plain_base(text)
