"""The conversation trie against a brute-force trie, with components solved in tasks and as joins."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from foldwise.llm import queries, trie


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    turns = {c: [t[2] for t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - c % 5 if c >= 0 else c + -c % 5
        made[c] = turns.get(head, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), up, len(m), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made_rows():
    rng = random.Random(3)
    rows = [
        (c, t, rng.choice(["u", "a", None]), rng.choice(["x", "é", "", None, "yy"]))
        for c in [*range(-7, 30), None]
        for t in [None, *range(rng.randrange(12))]
        if rng.random() < 0.8
    ]
    # A long conversation, ties, repeated rows, a conversation that is left without turns, and a long text.
    rows += [(100, t, "u", "x") for t in range(300)] + [(105, t % 7, "u", "x") for t in range(100)] + rows[:20]
    return rows + [(103, 1, "u", "q"), (107, 1, "u", "x"), (112, 1, "u", "x"), (200, 0, "u", "long " * 100_000), (205, 0, "u", "long " * 100_000)]


@pytest.mark.parametrize(("cell", "task_nodes"), [(4096, 20_000), (16, 60)])
def test_trie(spark, monkeypatch, cell, task_nodes):
    monkeypatch.setattr(trie, "CELL", cell)
    monkeypatch.setattr(trie, "TASK_NODES", task_nodes)
    rows = [(*r, 7, "extra") for r in made_rows()]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, rep string").repartition(5)
    assert sorted(map(tuple, trie.conversation_trie(table).collect()), key=str) == brute([r[:4] for r in rows])
    if cell == 16:
        assert trie.conversation_trie(table.limit(0)).count() == 0


def test_trie_query(spark, folder):
    folder = folder.replace("0.001", "0.01")
    rows = [tuple(r) for r in queries.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op11_prefix_trie(spark, folder).collect()), key=str) == brute(rows)
