"""The trie of conversations against building it turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from gossamer.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (abs(c) % 100) * (1 if c > 0 else -1), [])
        full = tuple(base[:h] + turns[h:])
        for d in range(len(full) + 1):
            node = nodes.setdefault(full[:d], [[], []])
            node[0].append(c)
            if d == len(full):
                node[1].append(c)
    kids = {path: 0 for path in nodes}
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    totals = {path: [0, 0] for path in nodes}
    for path, (members, _) in nodes.items():
        saved = (len(members) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            totals[path[:d]][0] += kids[path] == 0
            totals[path[:d]][1] += saved
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), kids[p], *totals[p], sha(e)) for p, (m, e) in nodes.items()),
        key=str,
    )


def found(spark, rows, **options):
    return sorted(map(tuple, prefix_trie.report(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


@pytest.mark.parametrize("block", [1, 2, 8])
def test_random_conversations_of_very_different_length(spark, block):
    rng = random.Random(block)
    rows = []
    for c in [*range(-105, -95), *range(0, 30), *range(1000, 1012), 5307, 5399]:
        n = 40 if c in (3, 1003) else rng.choice([0, 1, 1, 2, 3, 5, 9])
        rows += [(c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", f"text {rng.randint(0, 1 + t // 2)}é") for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 230) for t in range(12)]  # copies
    rng.shuffle(rows)
    assert found(spark, rows, block=block) == plain(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, None, "", "a"), (1, 2, "b", None), (1, 2, "a", "z"), (1, 2, "a", "z"), (None, 1, "user", "x"), (300, 5, "a:", "b"), (301, 5, "a", ":b"), (399, 1, "x", "y"), (2, -3, "r", "😀" * 500), (102, 1, "r", "t")]
    got = found(spark, rows)
    assert got == plain(rows)
    assert any(r[1] == 0 and r[2] is None for r in got)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []


def test_one_conversation_with_most_rows(spark):
    rows = [(0, t, "user", f"{t % 7}") for t in range(900)] + [(c, t, "user", f"{t % 7}") for c in range(1, 60) for t in range(c % 9)]
    assert found(spark, rows) == plain(rows)


def test_hot_parents_are_told_apart_from_the_rest(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT_PARENTS", 5)
    rows = [(c, t, "user", "first" if t == 0 else f"{c} {t}") for c in range(0, 6000, 100) for t in range(3)]
    assert found(spark, rows) == plain(rows)


def test_further_columns_and_conversations_as_they_are(spark):
    table = spark.createDataFrame([(7, 1, "u", "a", "x"), (7, 2, "u", "b", "x"), (8, 1, "u", "a", "x")], SCHEMA + ", name string")
    got = prefix_trie.trie(*prefix_trie.plain(table)).collect()
    assert sorted((r.depth, r.conv_id, r.n_convs, r.n_leaves, r.saved_tokens) for r in got) == [(0, 7, 2, 1, 1), (1, 7, 2, 1, 1), (2, 7, 1, 1, 0)]
