"""Conversation prefix trie against brute force over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyspark.llm import prefix_trie
from tallyspark.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, c string, seg int"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow_sequences(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0, digest), role, text))
    for c in turns:
        turns[c] = [t[1:] for t in sorted(turns[c])]
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        host = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = turns.get(host, [])[:h] + own[h:]
    return out


def slow_nodes(sequences):
    members = defaultdict(list)
    for c, sequence in sequences.items():
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    out = []
    for node, inside in members.items():
        ends = sorted(c for c in inside if len(sequences[c]) == len(node))
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), children[node],
                    sum(not children[x] for x in below[node]),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[node] if x),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == FIELDS
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


def random_rows(seed, convs=260, longest=9):
    rng = random.Random(seed)
    texts = [None, "", "a", "bb", "日本 🙂", "x" * 500, "c"]
    rows = []
    for c in rng.sample(range(-150, 420), convs):
        stem = rng.randrange(4)
        for k in range(rng.randrange(longest)):
            rows.append((c, rng.choice([None, k, k, k]), rng.choice([None, "user", ""]) if k > 2 else "user",
                         texts[stem] if k < 2 else rng.choice(texts)))
    rows += rows[::7] + [(None, 1, "user", "no id"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def test_nodes_of_rebuilt_conversations(spark):
    rows = random_rows(1)
    assert found(prefix_trie.prefix_trie(table(spark, rows))) == slow_nodes(slow_sequences(rows))
    assert prefix_trie.prefix_trie(table(spark, rows).limit(0)).count() == 0
    assert prefix_trie.prefix_trie(table(spark, [(None, 0, "user", "a")])).count() == 0


def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_prefix_trie(spark, sf)) == slow_nodes(slow_sequences(rows))


@pytest.mark.parametrize("segment, batch", [(2, 10), (3, 100_000), (1024, 7)])
def test_segments_and_batches_change_nothing(spark, segment, batch):
    rng = random.Random(segment)
    sequences = {}
    for c in range(200):
        stem = rng.choice(list(sequences.values()) or [[]])
        sequences[c] = (stem[:rng.randrange(len(stem) + 1)] + [("u", rng.choice("abc") * rng.randrange(4)) for _ in range(rng.randrange(6))])[:17]
    sequences[7] = sequences[300] = sequences[5] = [("u", "hot")] * 13
    rows = [(c, d, hashlib.md5(repr(t).encode()).digest(), len(t[1])) for c, s in sequences.items() for d, t in enumerate(s, 1)]
    rows += [(c, 0, None, 0) for c in sequences]
    df = spark.createDataFrame(rows, "c long, d long, digest binary, n long").repartition(5)
    assert found(prefix_trie.prefix_nodes(df, segment, batch)) == slow_nodes(sequences)


def test_group_of_copies_and_long_conversation(spark):
    rows = [(c, k, "user", f"same {k}") for c in range(1, 3000) if c % 100 for k in range(8, 14)]
    rows += [(100_000, k * 40, "user", "ab"[k % 2]) for k in range(150)] + [(200_001, k * 50, "user", "ab"[k % 2]) for k in range(160)]
    assert found(prefix_trie.prefix_trie(table(spark, rows))) == slow_nodes(slow_sequences(rows))


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            best = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert prefix_trie.two_fattest(low, high) == best


def test_exit_node_by_fat_binary_search():
    rng = random.Random(3)
    paths = [prefix_trie.prefix_digests(prefix_trie.ROOT, [bytes([rng.choice(b"ab")]) for _ in range(rng.randrange(1, 40))])
             for _ in range(300)]
    trie = prefix_trie.ZFastTrie(paths)
    for k, path in enumerate(paths[:200]):
        trie.add(k, len(path) - 1)
    nodes = {paths[trie.of[n]][trie.high[n]] for n in range(len(trie.up))}
    asked = [0]
    real = trie.handle

    class Counted(dict):
        def get(self, key):
            asked[0] += 1
            return real.get(key)

    trie.handle = Counted()
    for path in paths[200:]:
        asked[0] = 0
        best, child = trie.exit_node(path, len(path) - 1, trie.roots[prefix_trie.ROOT])
        assert paths[trie.of[best]][trie.high[best]] == [h for h in path if h in nodes][-1]
        assert asked[0] <= 7  # about log2 of the length
        edge = paths[trie.of[child]][trie.low[child] + 1] if child is not None else None
        assert (edge in path) if child is not None else True
