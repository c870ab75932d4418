"""Codes of vectors against plain Lloyd rounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from gossamer.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("n", "k", "width", "spread"), [(1, 1, 4, 10), (5, 5, 4, 10), (17, 3, 1, 3), (3000, 37, 3, 2), (4000, 64, 4, 60), (2000, 64, 4, 1)])
def test_both_trees_find_the_nearest_entry(n, k, width, spread):
    rng = np.random.default_rng(n)
    points = np.floor(rng.normal(size=(n, width)) * spread).astype(np.int64)
    entries = points[rng.integers(0, n, k)]  # also equal entries: the first of them counts
    chosen, counts, sums = codes.nearest(codes.Tree(points, codes.LEAF), codes.Tree(entries, 1))
    want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (chosen == want).all()
    assert (counts == np.bincount(want, minlength=k)).all()
    total = np.zeros((k, width), np.int64)
    np.add.at(total, want, points)
    assert (sums == total).all()


def test_whole_nodes_are_assigned_without_their_points():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (64, 4))
    points = (centres[rng.integers(0, 64, 20000)] + rng.integers(-20, 20, (20000, 4))).astype(np.int64)
    tree = codes.Tree(points, codes.LEAF)
    asked = []
    tree.points = Watched(tree.points, asked)
    codes.nearest(tree, codes.Tree(centres, 1))
    assert sum(asked) < len(points)  # of 64 times as many pairs


class Watched(np.ndarray):
    """An array that notes how many rows are taken out of it."""

    def __new__(cls, base, log):
        out = base.view(cls)
        out.log = log
        return out

    def __array_finalize__(self, base):
        self.log = getattr(base, "log", None)

    def __getitem__(self, key):
        out = super().__getitem__(key)
        if isinstance(key, np.ndarray) and self.log is not None:
            self.log.append(len(key))
        return np.asarray(out)


def plain(rows):
    """code and error by vec_id, label_error and digest, by comparing all with all."""
    kept = sorted([r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(r[1]) for r in kept) // codes.PARTS))
    full = [[max(-codes.LARGEST, min(codes.LARGEST, math.floor(256 * float(np.float32(x))))) for x in r[1]] for r in kept]
    full = np.array([f + [0] * (width * codes.PARTS - len(f)) for f in full]).reshape(len(kept), codes.PARTS, width)
    books = full[: codes.ENTRIES].transpose(1, 0, 2).copy()

    def assign():
        far = ((full.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(3)
        return far.argmin(2), far.min(2)

    for _ in range(codes.ROUNDS):
        at, _ = assign()
        for p in range(codes.PARTS):
            for e in set(at[p]):
                books[p, e] = full[at[p] == e, p].sum(0) // (at[p] == e).sum()
    at, far = assign()
    error = far.sum(0)
    labels = {}
    for r, e in zip(kept, error):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in at[:, i]), int(error[i]), labels[r[2]], digest) for i, r in enumerate(kept)), key=str)


def found(spark, rows):
    return sorted(map(tuple, codes.report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_report_equals_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=32) * 0.2], [None, 1, 2][i % 3]) for i in rng.permutation(400)]
    rows += [(7000 + i, rows[0][1], 1) for i in range(300)]  # a hot vector and label
    assert found(spark, rows) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 16, 1), (2, None, 1), (3, [nan] + [0.0] * 15, 1), (4, [inf] * 16, None), (5, [-inf] * 16, None), (6, [None] + [0.1] * 15, 2), (7, [], None)]
    rows += [(8, [1.0] * 5, None), (9, [-3.4e38] * 20, 3), (9, [3.4e38] * 20, 3), (None, [-0.001] * 16, 4), (1, [0.25] * 16, 1), (1, [0.5] * 16, 1)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[1:6]) == []
    assert found(spark, []) == []


def test_codes_decode_to_near_vectors_and_keep_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16) * 0.3], i % 3) for i in range(300)]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", code string")
    books = codes.train(table)
    coded = codes.encode(table, books)
    assert coded.columns == ["vec_id", "embedding", "label", "code", "code_", "error"]
    back = codes.decode(coded, books, code="code_").collect()
    assert len(back) == 300 and all(r.code == "x" for r in back)
    assert np.mean([np.square(np.array(r.decoded) - np.array(r.embedding)).sum() for r in back]) < 0.2 * 16 * 0.09
