"""The prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.llm import prefix_trie as P
from docweave.llm.common import prepare

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def listed(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    def head(c):
        return zlib.crc32(str(c).encode()) % 9

    return {c: convs.get(c - c % 5, [])[:head(c)] + own[head(c):] for c, own in convs.items()}


def brute(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(node))
        out.add((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node],
                 saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def corpus(seed, n=80):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([1, 2, 5, 12])):
            rows.append((c + (c > n // 2), t, rnd.choice(["user", "assistant", None]) if rnd.random() < 0.1 else "user",
                         rnd.choice(["a", "é", "", None, "same"]) if rnd.random() < 0.8 else f"t{rnd.randrange(40)}"))
    return rows


def nodes(out):
    rows = [tuple(r[c] for c in COLUMNS) for r in out.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    prepare(spark)
    rows = [r for r in corpus(seed) if r[0] % 7 != 5]  # some runs lack their first conversation
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    assert nodes(P.op12_prefix_trie(spark, str(tmp_path))) == brute(rebuilt(listed(rows)))


def test_screening_changes_nothing(spark):
    """The same nodes if nearly all prefixes collide in the sketch, and a conversation over several tasks."""
    prepare(spark)
    rows = corpus(3, 40) + [(500, t, "user", f"long {t}") for t in range(700)]
    rows += [(501, t, "user", f"long {t}") for t in range(650)] + [(502, t, "user", f"long {t}") for t in range(650)]
    want = brute(listed(rows))
    turns = P.numbered_turns(P.turn_digests(spark.createDataFrame(rows, SCHEMA)))
    ids = turns.select("conv").distinct()
    assert turns.rdd.getNumPartitions() >= 1
    for cells in (1024, 1 << 18):
        assert nodes(P.prefix_trie(turns, ids, cells)) == want
    screened = P.screened(P.prefix_digests(turns), 1 << 18)
    alone = {(r.conv, r.pos) for r in screened.filter("alone").collect()}
    convs = listed(rows)
    counts = defaultdict(int)
    for own in convs.values():
        for d in range(1, len(own) + 1):
            counts[tuple(own[:d])] += 1
    assert alone == {(c, d) for c, own in convs.items() for d in range(1, len(own) + 1) if counts[tuple(own[:d])] == 1}


def test_edge_cases(spark):
    prepare(spark)
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, 0, "user", "x"), (2, None, "", ""), (2, 3, "user", "x"),
            (2, 3, "user", "x"), (-7, 5, "user", "y" * 300_000), (9, 1, "us", "erx"), (9, 2, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(listed(rows))
    assert nodes(P.conversation_trie(df)) == want
    clash = df.select("*", F.lit(1).alias("conv"), F.lit(2).alias("pos"), F.lit("r").alias("TEXT"))
    assert nodes(P.conversation_trie(clash)) == want
    empty = P.conversation_trie(df.limit(0))
    assert empty.columns == COLUMNS and empty.count() == 0


def test_conversations_without_turns(spark):
    prepare(spark)
    turns = P.numbered_turns(P.turn_digests(spark.createDataFrame([(4, 1, "u", "x")], SCHEMA)))
    ids = spark.createDataFrame([(1,), (2,), (4,)], "conv bigint")
    assert nodes(P.prefix_trie(turns, ids)) == brute({1: [], 2: [], 4: [("u", "x")]})
    assert nodes(P.prefix_trie(turns.limit(0), ids)) == brute({1: [], 2: [], 4: []})
