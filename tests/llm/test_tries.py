"""The prefix trie of conversations against a plain one."""

import hashlib
import zlib

from pyspark.sql import functions as F

from gradeline.llm import queries, turntrie


def plain_nodes(sequences):
    """{(prefix)} -> row, from conv_id -> tuple of (role, text)."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = set()

    def gain(p):
        return (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0

    for p, convs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(sequences[c]) == len(p)))
        out.add((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(kids.get(p, [])),
                 sum(q not in kids for q in below), sum(map(gain, below)), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def plain_rebuilt(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    by_conv = {c: tuple(x[2:] for x in sorted(t)) for c, t in by_conv.items()}
    out = {}
    for c, own in by_conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = by_conv.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), ())[:h] + own[h:]
    return out


def nodes_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_trie_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = nodes_of(queries.conversation_trie(spark, sf))
    assert len(got) == len(set(got)) and set(got) == plain_nodes(plain_rebuilt(rows))


def test_trie_over_many_shards_and_odd_rows(spark):
    rows = []
    for c in range(-6, 60):
        for t in range(c % 4 + 3):
            rows.append((c, t, "user" if t % 2 else None, f"t{t}" if c % 3 else f"t{t}-{c % 7}"))
    rows += [(100 + c, t, "user", "same") for c in range(12) for t in range(9)]  # copies
    rows += [(200, t, "a", f"deep {t}") for t in range(300)] + [(205, t, "a", f"deep {t}") for t in range(280)]
    rows += [(300, None, "x", None), (300, 1, "x", "é"), (301, None, None, None), (None, 1, "x", "lost"), (302, 1, "x", "twice"), (302, 1, "x", "twice")]
    table = spark.createDataFrame([(*r, "key", 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, seq string, ids int")
    sequences = turntrie.with_shared_heads(turntrie.encoded(table))
    expected = plain_nodes(plain_rebuilt(rows))
    for size in (7, 60, 100_000):
        got = nodes_of(turntrie.prefix_nodes(sequences, size))
        assert len(got) == len(expected) and set(got) == expected


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert nodes_of(turntrie.prefix_nodes(turntrie.with_shared_heads(turntrie.encoded(empty)))) == []
    bare = spark.createDataFrame([(4, [], []), (9, [], [])], "conv_id bigint, ids array<bigint>, sizes array<bigint>")
    ends = hashlib.sha256(b"4,9").hexdigest()
    assert nodes_of(turntrie.prefix_nodes(bare)) == [(4, 0, None, 2, 0, 1, 0, ends)]


def test_trees_insert_medians_first(spark):
    rows = [([k], [1], 1, k, None) for k in range(1000)]
    nodes = turntrie.shard_nodes(rows)
    assert len(nodes) == 1001 and nodes[0][6] == 1000
    tree = turntrie.TernaryTree()
    for k in (5, 2, 8):
        tree.insert([k], [1])
    assert tree.less[1] == 2 and tree.more[1] == 3


def test_runs_of_ids_are_hashed_in_order(spark):
    table = spark.range(30_000).select((F.col("id") * 7 - 9).alias("conv_id"), F.array().cast("array<bigint>").alias("ids"),
                                       F.array().cast("array<bigint>").alias("sizes"))
    got = nodes_of(turntrie.prefix_nodes(table))
    assert got[0][-1] == hashlib.sha256(",".join(str(k * 7 - 9) for k in range(30_000)).encode()).hexdigest()
