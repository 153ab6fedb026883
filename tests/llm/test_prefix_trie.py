import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meadowlark.llm import prefix_trie
from meadowlark.llm.prefix_trie import POINTS, PRIME

TURNS = "conv_id long, turn long, role string, text string"
below = st.integers(0, PRIME - 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(below, below), min_size=1, max_size=30), st.lists(st.integers(0, (1 << 36) - 1), min_size=1, max_size=20))
def test_arithmetic(pairs, exponents):
    x, y = (np.array(v, np.uint64) for v in zip(*pairs))
    assert prefix_trie.times(x, y).tolist() == [a * b % PRIME for a, b in pairs]
    assert prefix_trie.running(x).tolist() == [sum(a for a, _ in pairs[: k + 1]) % PRIME for k in range(len(pairs))]
    assert prefix_trie.powers(POINTS[0], np.array(exponents)).tolist() == [pow(POINTS[0], n, PRIME) for n in exponents]


def brute_force(rows):
    """The contract's figures from whole sequences of turns."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    rebuilt = {}
    for c in list(own):
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids[node], leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def agree(spark, rows, partitions=5):
    df = spark.createDataFrame(rows, TURNS).repartition(partitions)
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr) == brute_force(rows)


def random_rows(r, conversations, longest):
    texts = ["", "a", "ä ö", "please help", "yes " * 300, None]
    return [
        (c, r.choice([k, k, k, None]), r.choice(["user", "assistant", None, ""]), r.choice(texts[: r.randint(1, 6)]))
        for c in r.sample(range(400), conversations) for k in range(r.randint(1, longest))
    ]


@pytest.mark.parametrize("seed, conversations, longest", [(1, 60, 4), (2, 20, 12), (3, 40, 1)])
def test_random_tables(spark, seed, conversations, longest):
    agree(spark, random_rows(random.Random(seed), conversations, longest))


def test_one_conversation_over_all_partitions(spark):
    """A third of all rows and more in one conversation, which lies in every partition of the sort."""
    r = random.Random(7)
    long = [(10, k, "user", r.choice("abc")) for k in range(700)] + [(13, k, "user", "a") for k in range(300)]
    agree(spark, long + random_rows(r, 30, 6))


def test_odd_rows(spark):
    same = [(c, 0, "system", "be kind") for c in range(0, 600, 5)]  # equal conversations: more ends than one row of ids holds
    rows = same + [(1, 0, "user", "x")] * 3 + [(2, None, None, None), (2, None, None, None), (None, 0, "user", "lost"), (7, 1, "user", "y"), (21, 0, "", "z" * 50_000)]
    agree(spark, rows)


def test_very_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 7)
    agree(spark, [(c, 0, "system", "be kind") for c in range(0, 900, 5)])


def test_empty_table_and_further_columns(spark):
    empty = prefix_trie.prefix_trie(spark.createDataFrame([], TURNS))
    assert empty.collect() == [] and empty.columns[0] == "conv_id" and "ends_sha256" in empty.columns
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], TURNS)).collect() == []
    rows = [(5, 0, "user", "a", 1, 2, 3), (6, 0, "user", "a", 1, 2, 3)]
    df = spark.createDataFrame(rows, TURNS + ", n long, key long, depth long")
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr) == brute_force([r[:4] for r in rows])


def test_colliding_orders_have_different_digests():
    """The same turns in another order, and one turn repeated, are other sequences."""
    t = np.array([5, 9, 5, 5], np.uint64)
    seen = set()
    for order in ([0, 1], [1, 0], [0, 2], [0, 2, 3], [0], []):
        x = t[order]
        seen.add(tuple(int(prefix_trie.running(prefix_trie.times(x, prefix_trie.powers(p, np.arange(1, len(x) + 1))))[-1]) if len(x) else 0 for p in POINTS))
    assert len(seen) == 6
