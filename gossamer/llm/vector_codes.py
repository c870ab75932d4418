"""Vector code compression: a codebook for each part of the vectors, trained by dual-tree Lloyd rounds.

Components become integers, vectors are cut into equal parts, and every part position has a codebook.  A task
builds a tree over the parts of a block of rows and one over the entries of the codebook, both with bounding
boxes, and descends both at once: a pair of nodes goes when its least distance is above the largest distance
that some other entry node can have.  A node of parts with one entry left is assigned as a whole by its cached
count and sum; the parts of leaves that stay uncertain are compared one by one, in integers.  Tasks return
counts and sums for each entry, Spark adds them up, and the driver holds the codebooks only, whose size does
not follow the rows.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; a shorter vector
counts as if zeros followed, up to the longest one and a multiple of the parts; integers beyond LARGEST count as
LARGEST, so that sums of squares stay exact; fewer rows than entries give fewer entries; ties between rows of one
vec_id at the start go to the smaller vector, rows without vec_id come last; repeated rows count as often as
they occur; an empty table has no rows; further columns are carried on by encode().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm.common import fresh, stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Squares of differences and their sums over 8,000 components stay below 2**63.
LARGEST = 1 << 24
#: Parts in a leaf, at most; components that one block holds.
LEAF, BLOCK = 16, 1 << 20
#: Label groups are dealt into so many parts before they meet their sums.
SALTS = 16


class Tree:
    """Points (n x width integers) halved along their widest side, level by level, down to `leaf` points a node.

    Node i of a level has the points order[cut[i]:cut[i + 1]] and the children 2i and 2i + 1 of the next level.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        self.order, cut = np.arange(n), np.array([0, n])
        self.cuts, depth = [cut], 0
        while -(-n >> depth) > leaf:
            node = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            low, high = self._boxes(points[self.order], cut)
            side = (high - low).argmax(1)
            self.order = self.order[np.lexsort((points[self.order, side[node]], node))]
            halves = np.empty(2 * len(cut) - 1, dtype=cut.dtype)
            halves[::2], halves[1::2] = cut, (cut[:-1] + cut[1:]) // 2
            cut, depth = halves, depth + 1
            self.cuts.append(cut)
        self.points = points[self.order]
        boxes = [self._boxes(self.points, c) for c in self.cuts]
        self.low, self.high = [b[0] for b in boxes], [b[1] for b in boxes]
        self.running = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), self.points.cumsum(0)])

    @staticmethod
    def _boxes(points: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest components of each node; an empty node's do not matter."""
        begin = np.minimum(cut[:-1], len(points) - 1)
        return np.minimum.reduceat(points, begin), np.maximum.reduceat(points, begin)

    def size(self, level: int) -> np.ndarray:
        return np.diff(self.cuts[level])

    def sums(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The cached sums of whole nodes."""
        cut = self.cuts[level]
        return self.running[cut[nodes + 1]] - self.running[cut[nodes]]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of begin[i] .. begin[i] + size[i] - 1, one range after the other."""
    return np.arange(size.sum()) + np.repeat(begin - (size.cumsum() - size), size)


def nearest(parts: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point of `parts` the index of its nearest entry (ties to the lower index), and counts and sums
    of the points of each entry."""
    k, width = entries.points.shape
    chosen = np.empty(len(parts.points), dtype=np.int64)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    at, last = [0, 0], [len(parts.cuts) - 1, len(entries.cuts) - 1]
    while len(a):
        low, high = parts.low[at[0]][a], parts.high[at[0]][a]
        under, over = entries.low[at[1]][b], entries.high[at[1]][b]
        gap = np.maximum(np.maximum(under - high, low - over), 0)
        reach = np.maximum(over - low, high - under)
        least, most = (gap * gap).sum(1), (reach * reach).sum(1)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        members = np.diff(np.append(first, len(a)))
        stays = least <= np.repeat(np.minimum.reduceat(most, first), members)
        a, b = a[stays], b[stays]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        members = np.diff(np.append(first, len(a)))
        # one pair left, and one entry in it: the node is assigned as a whole
        sure = np.repeat(members == 1, members) & (entries.size(at[1])[b] == 1)
        whole, entry = a[sure], entries.order[entries.cuts[at[1]][b[sure]]]
        cut, size = parts.cuts[at[0]], parts.size(at[0])
        np.add.at(counts, entry, size[whole])
        np.add.at(sums, entry, parts.sums(at[0], whole))
        chosen[_ranges(cut[whole], size[whole])] = np.repeat(entry, size[whole])
        a, b = a[~sure], b[~sure]
        if at == last:
            break
        for side in (0, 1):
            if at[side] < last[side]:
                tree, level = (parts, entries)[side], at[side] + 1
                a, b = ((2 * a)[:, None] + [0, 1], np.repeat(b, 2).reshape(-1, 2)) if side == 0 else (np.repeat(a, 2).reshape(-1, 2), (2 * b)[:, None] + [0, 1])
                a, b = a.ravel(), b.ravel()
                real = tree.size(level)[(a, b)[side]] > 0
                a, b = a[real], b[real]
                at[side] = level
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
    if len(a):  # uncertain leaves: every point against every entry that is left for its leaf
        cut, size = parts.cuts[-1], parts.size(len(parts.cuts) - 1)
        entry = entries.order[entries.cuts[-1][b]]
        point, entry = _ranges(cut[a], size[a]), np.repeat(entry, size[a])
        gap = parts.points[point] - np.take(_in_order(entries), entry, axis=0)
        far = (gap * gap).sum(1)
        order = np.lexsort((entry, far, point))
        best = order[np.concatenate([[True], point[order][1:] != point[order][:-1]])]
        point, entry = point[best], entry[best]
        chosen[point] = entry
        counts += np.bincount(entry, minlength=k)
        np.add.at(sums, entry, parts.points[point])
    out = np.empty_like(chosen)
    out[parts.order] = chosen
    return out, counts, sums


def _in_order(tree: Tree) -> np.ndarray:
    """The points of a tree as they were given."""
    out = np.empty_like(tree.points)
    out[tree.order] = tree.points
    return out


def _integers(column, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of rows of an Arrow list column as integers, parts x rows x width."""
    step = max(LEAF, BLOCK // max(1, width * PARTS))
    for lo in range(0, len(column), step):
        part = column.slice(lo, step)
        lengths = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.floor(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).clip(-LARGEST, LARGEST).astype(np.int64)
        full = np.zeros((len(part), width * PARTS), np.int64)
        full[np.repeat(np.arange(len(part)), lengths), _ranges(np.zeros(len(part), np.int64), lengths)] = flat
        yield slice(lo, lo + len(part)), full.reshape(len(part), PARTS, width).transpose(1, 0, 2)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & finite)


def _start(kept: DataFrame, vector: str, key: str) -> np.ndarray:
    """The first codebooks: parts x entries x width."""
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    first = kept.select(key, vector).orderBy(F.col(key).asc_nulls_last(), vector).limit(ENTRIES).collect()
    import pyarrow as pa

    column = pa.array([r[1] for r in first], pa.list_(pa.float64()))
    blocks = [block for _, block in _integers(column, width)]
    return np.concatenate(blocks, axis=1) if blocks else np.zeros((PARTS, 0, width), np.int64)


def _refined(kept: DataFrame, books: np.ndarray, vector: str) -> np.ndarray:
    """One Lloyd round: codebooks whose used entries are the floored means of their parts."""
    _, k, width = books.shape

    def totals(batches):
        import pyarrow as pa

        entries = [Tree(book, 1) for book in books]
        counts, sums = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, width), np.int64)
        for batch in batches:
            for _, block in _integers(batch.column(0), width):
                for p in range(PARTS):
                    _, c, s = nearest(Tree(block[p], LEAF), entries[p])
                    counts[p] += c
                    sums[p] += s
        part, entry = np.nonzero(counts)
        if len(part):
            values = pa.array(np.concatenate([counts[part, entry][:, None], sums[part, entry]], axis=1).ravel())
            names = [np.repeat(part, width + 1), np.repeat(entry, width + 1), np.tile(np.arange(width + 1), len(part))]
            yield pa.RecordBatch.from_arrays([*(pa.array(n.astype(np.int32)) for n in names), values], names=["part", "entry", "pos", "total"])

    found = kept.select(vector).mapInArrow(totals, "part int, entry int, pos int, total long")
    new, whole = books.copy(), np.zeros((PARTS, k, width + 1), np.int64)
    for r in found.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total")).collect():  # entries x components, however many rows
        whole[r.part, r.entry, r.pos] = r.total
    part, entry = np.nonzero(whole[:, :, 0])
    new[part, entry] = whole[part, entry, 1:] // whole[part, entry, :1]
    return new


def train(vectors: DataFrame, rounds: int = ROUNDS, vector: str = "embedding", key: str = "vec_id") -> np.ndarray:
    """The codebooks of `vectors`: parts x entries x components of a part."""
    kept = usable(vectors, vector)
    books = _start(kept, vector, key)
    for _ in range(rounds if books.shape[1] else 0):
        books = _refined(kept, books, vector)
    return books


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Adds to the usable rows of `vectors` their code (two hex digits a part) and error (squared distance to it).

    Where `vectors` has columns of these names, the new ones get underscores behind theirs.
    """
    code, error = fresh(vectors, "code", "error")
    schema = T.StructType([*vectors.schema.fields, T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])
    at = vectors.columns.index(vector)

    def run(batches):
        import pyarrow as pa

        entries = [Tree(book, 1) for book in books if len(book)]
        for batch in batches:
            for rows, block in _integers(batch.column(at), books.shape[2]):
                codes, errors = np.empty((block.shape[1], PARTS), np.uint8), np.zeros(block.shape[1], np.int64)
                for p in range(PARTS):
                    chosen, _, _ = nearest(Tree(block[p], LEAF), entries[p])
                    codes[:, p] = chosen
                    errors += ((block[p] - books[p][chosen]) ** 2).sum(1)
                text = codes.tobytes().hex()
                part = batch.slice(rows.start, rows.stop - rows.start)
                new = [pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(errors)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return usable(vectors, vector).mapInArrow(run, schema)


def decode(coded: DataFrame, books: np.ndarray, code: str = "code", name: str = "decoded") -> DataFrame:
    """Adds the vector that a code stands for: the middle of each component's integer, over SCALE."""
    values = ((books + 0.5) / SCALE).tolist()
    book = F.lit("[" + ",".join("[" + ",".join(str(e) for e in part) + "]" for part in values) + "]")
    table = F.from_json(book, "array<array<array<double>>>")
    entry = lambda p: F.conv(F.substring(F.col(code), F.lit(2) * p + 1, F.lit(2)), 16, 10).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.element_at(F.element_at(table, p + 1), entry(p) + 1))
    return coded.withColumn(name, F.flatten(parts))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the usable rows of `vectors` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", "embedding")
    books = train(rows)
    coded = stage(encode(rows, books).select("vec_id", "label", "code", "error"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    # a label may have a third of all rows: its sum goes to every one of SALTS parts
    dealt = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("to"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(dealt, salted["label"].eqNullSafe(dealt["of"]) & (salted["salt"] == dealt["to"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds spelt out for DuckDB: every part against every entry."""

    def assigned(n: int) -> str:
        return f"""a{n} AS (SELECT id, part, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': entry}}) AS best
            FROM p JOIN e{n} USING (part) GROUP BY id, part)"""

    def refined(n: int) -> str:
        return f"""s{n} AS (SELECT part, entry, list(m ORDER BY pos) AS c FROM (
              SELECT part, best.e AS entry, pos, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS m
              FROM (SELECT part, best, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{n}) GROUP BY ALL) GROUP BY ALL),
            e{n + 1} AS (SELECT part, entry, coalesce(s{n}.c, e{n}.c) AS c FROM e{n} LEFT JOIN s{n} USING (part, entry))"""

    return f"""WITH r AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v
              FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            p AS (SELECT id, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x FROM r, range({PARTS}) AS t(part)),
            e0 AS (SELECT part, id - 1 AS entry, x AS c FROM p WHERE id <= {ENTRIES}),
            {", ".join(x for n in range(ROUNDS) for x in (assigned(n), refined(n)))}, {assigned(ROUNDS)},
            b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{ROUNDS}),
            o AS (SELECT id, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN o USING (id), b"""


#: Vectors of one length, as in the given tables.
ORACLE = _oracle()
