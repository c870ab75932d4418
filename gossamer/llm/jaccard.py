"""N-gram Jaccard join by chosen paths.

Documents are sets of shingles of five words.  Equal sets form a class, of which one document stands for
all.  Each class has a min-wise signature; the recursion splits the classes by the value of one sampled
signature coordinate (two at every fourth node), so that the members of a node share a token.  A node of
at most SMALL members is a bucket; a larger one is split again, DEPTH times at most.  Runs with other
samples are repeated until a pair at the threshold shares a bucket with probability `recall`.

Inside buckets signatures are compared, pair by pair, and what is near is linked to the bucket's first
near member (a spanning forest, never all pairs); a node that stays large at the last depth is linked as
a whole.  The components of these links are then compared exactly, set by set, in blocks of BLOCK x BLOCK
classes: every pair of different sets with a Jaccard similarity of at least THRESHOLD counts as a link of
both, and the components of the links are the groups.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.  Defined results: a text of
one to four words has one shingle; a text without words stands alone, without links; rows with the same
doc_id and text are one document and share its result; a null doc_id counts as the least id; an empty table has
no rows; all columns of a table are kept as they are by keep_first().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import Memo, claim, fresh, normal_words, stage
from gossamer.llm.components import components, salted_join

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
SMALL = 128
DEPTH = 4
BLOCK = 128
#: Signatures that agree in this share of coordinates are candidates: four standard errors below THRESHOLD.
NEAR = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)
_NO_ID = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_HASHES = Memo(xxhash.xxh64_intdigest)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = normal_words(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        total = _mixed((total ^ hashes[j : j + len(total)]) * _ODD)
    return np.unique(total)


def _signature(s: np.ndarray, odd: np.ndarray, add: np.ndarray) -> bytes:
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(s), 4096):
        part = ((s[lo : lo + 4096, None] * odd + add) >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, part.min(0))
    return least.tobytes()


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """_id, _th, cls (hash of the shingle set, null without words), size, sig of every row of `docs`."""

    def run(batches):
        claim("jaccard")
        odd, add = _functions()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                cls = [int.from_bytes(xxhash.xxh64_digest(s.tobytes()), "little", signed=True) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([_signature(s, odd, add) if len(s) else None for s in sets], pa.binary())],
                    names=["_id", "_th", "cls", "size", "sig"],
                )

    return keyed(docs).select("_id", "_th", "text").mapInArrow(run, "_id long, _th long, cls long, size int, sig binary")


def _key() -> tuple:
    """What rows are known by: doc_id and the hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), F.xxhash64("text")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumns(dict(zip(("_id", "_th"), _key(), strict=True)))


def runs_needed(recall: float, share: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs after which a pair of similarity `share` met in a bucket of the last depth with probability `recall`."""
    p = 1.0
    for _ in range(depth):
        miss = 1 - share * p
        p = 1 - (0.75 * miss + 0.25 * miss * miss)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _children(nodes: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (node, signature) its child nodes, and the row each child came from."""
    h = _mixed(nodes * _ODD + np.uint64(1))
    rows = np.arange(len(nodes))
    second = (h >> np.uint64(8)) % np.uint64(4) == 0
    at = np.concatenate([rows, rows[second]])
    coordinate = np.concatenate([h % np.uint64(COORDINATES), (h[second] >> np.uint64(16)) % np.uint64(COORDINATES)])
    value = signatures[at, coordinate.astype(np.int64)].astype(np.uint64)
    return _mixed((h[at] ^ (value + (coordinate << np.uint64(32)))) * _ODD), at


def _split(members: DataFrame, roots: list[int] | None = None) -> DataFrame:
    """(node, cls) of the children of `members` (node, cls, sig), or of every root for (cls, sig)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signatures = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            starts = [np.full(len(cls), r, np.uint64) for r in roots] if roots else [batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)]
            for nodes in starts:
                child, at = _children(nodes, signatures)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(cls[at])], names=["node", "cls"])

    return members.mapInArrow(run, "node long, cls long")


def _runs(batches, key: list[str]):
    """Whole groups, as record batches, of rows that come sorted by `key`."""
    rest = None
    for batch in batches:
        whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not whole.num_rows:
            continue
        keys = np.stack([whole.column(k).to_numpy() for k in key])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        whole = whole.combine_chunks()
        for lo, hi in zip([0, *cuts[:-1]], cuts):
            yield whole.slice(lo, hi - lo)
        rest = whole.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of booleans the first row of its component."""
    n = len(near)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            front = np.zeros(n, bool)
            front[i] = True
            while front.any():
                root[front] = i
                front = near[front].any(0) & (root < 0)
    return root


def _near_in_buckets(buckets: DataFrame) -> DataFrame:
    """(a, b) links between near signatures of `buckets` (node, cls, sig)."""

    def run(batches):
        a, b = [], []
        for group in _runs(batches, ["node"]):
            if group.num_rows > 1:
                cls = group.column("cls").to_numpy()
                s = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                root = _forest((s[:, None, :] == s[None, :, :]).mean(2) >= NEAR) if len(s) > 2 else np.array([0, 0 if (s[0] == s[1]).mean() >= NEAR else 1])
                at = np.flatnonzero(root != np.arange(len(s)))
                a += cls[at].tolist()
                b += cls[root[at]].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return buckets.repartition("node").sortWithinPartitions("node", "cls").mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """(a, b) candidate links between `classes` (cls, sig): a forest that connects all that share a bucket."""
    roots = [int(r) for r in np.random.default_rng(3).integers(1, 1 << 62, runs_needed(recall))]
    members, found = _split(classes.select("cls", "sig"), roots), []
    for depth in range(1, DEPTH + 1):
        members = members.distinct() if depth > 1 else members
        sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("cls").alias("least")).where("n > 1")
        rows = stage(members.join(sizes, "node"))
        small = rows.where(F.col("n") <= SMALL).select("node", "cls").join(classes.select("cls", "sig"), "cls")
        found.append(_near_in_buckets(small.select("node", "cls", "sig")))
        large = rows.where(F.col("n") > SMALL)
        if depth == DEPTH:
            found.append(large.select(F.col("cls").alias("a"), F.col("least").alias("b")))
            break
        if not large.limit(1).count():
            break
        members = _split(large.select("node", "cls").join(classes.select("cls", "sig"), "cls").select("node", "cls", "sig"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _exact_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """(cls, links, root) per block pair of `blocks` (comp, i, j, side, cls, grams), side 0 against side 1 (or 0 itself)."""

    def run(batches):
        out: dict[str, list] = {"cls": [], "links": [], "root": []}
        for group in _runs(batches, ["comp", "i", "j"]):
            cls, side = group.column("cls").to_numpy(), group.column("side").to_numpy()
            grams = group.column("grams").combine_chunks()
            near = _near_sets(grams, threshold)
            one = group.column("i")[0] == group.column("j")[0]
            across = ~np.eye(len(cls), dtype=bool) if one else side[:, None] != side[None, :]
            near &= across
            links, root = near.sum(1), _forest(near)
            at = np.flatnonzero(links)
            out["cls"] += cls[at].tolist()
            out["links"] += links[at].tolist()
            out["root"] += cls[root[at]].tolist()
            if len(out["cls"]) > 50_000:
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})
                out = {k: [] for k in out}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    sorted_blocks = blocks.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "cls")
    return sorted_blocks.mapInArrow(run, "cls long, links long, root long")


def _near_sets(grams, threshold: float) -> np.ndarray:
    """Which pairs of sets (a list array of distinct hashes) have at least this Jaccard similarity."""
    raw = grams.values.to_numpy() if hasattr(grams, "values") else grams.flatten().to_numpy()
    ends = grams.offsets.to_numpy()
    raw, sizes = raw[ends[0] : ends[-1]], np.diff(ends)
    _, term, count = np.unique(raw, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = count > 1
    new = np.cumsum(shared) - 1
    keep = shared[term]
    term, owner = new[term[keep]], owner[keep]
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[order]
    common = np.zeros((len(sizes), len(sizes)), np.float32)
    width = max(64, (1 << 22) // max(1, len(sizes)))
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(term, [lo, lo + width])
        x = np.zeros((len(sizes), width), np.float32)
        x[owner[a:b], term[a:b] - lo] = 1
        common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    return common >= threshold * union - 1e-6 * union


def groups(docs: DataFrame, recall: float = RECALL, threshold: float = THRESHOLD) -> DataFrame:
    """_id, _th, root (a key of the group), class_id, n_links, n_copies of every row of `docs` (doc_id, text).

    class_id is the least doc_id of the group, n_links the number of other shingle sets that the document's
    set is linked with, n_copies the number of rows with its set.
    """
    rows = stage(sketches(docs))
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("_id", "_th")).alias("first"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"))
    classes = stage(classes)
    near = stage(components(candidates(classes, recall)).select(F.col("node").alias("cls"), F.col("root").alias("comp")))
    # few components have more than one block, so that their table is joined without moving the others
    large = stage(near.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")).where("k > 1"))
    placed = near.join(large, "comp", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    firsts = classes.select("cls", F.col("first._id").alias("_id"), F.col("first._th").alias("_th"))
    members = placed.join(firsts, "cls")
    # a row that occurs again is the same document
    texts = keyed(docs).select("_id", "_th", "text").join(members, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("cls", "comp", "k", "block", "text")

    def cut(batches):
        claim("jaccard")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                grams = pa.array([shingles(t).view(np.int64) for t in part.column(4).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], grams], names=["cls", "comp", "k", "block", "grams"])

    sets = texts.mapInArrow(cut, "cls long, comp long, k int, block int, grams array<long>")
    # a block meets each block once: (i, j) with i <= j, from either side
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    pairs = sets.withColumn("other", other).select("cls", "comp", "grams", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    linked = stage(_exact_links(pairs.select("comp", "i", "j", "side", "cls", "grams"), threshold))
    links = linked.groupBy("cls").agg(F.sum("links").alias("n_links"))
    linked_roots = components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cls"), "root")
    known = classes.select("cls", F.col("first._id").alias("_id"), "n_copies").join(links, "cls", "left").join(linked_roots, "cls", "left")
    # a group may be large: its least id is looked up by salted members; a class without links is its own group
    linked = known.where("root IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("_id").alias("class_id"))
    linked = salted_join(linked, least, "root", "cls").select("cls", "root", "class_id", "n_links", "n_copies")
    known = linked.unionByName(known.where("root IS NULL").select("cls", F.col("cls").alias("root"), F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_copies"))
    return rows.select("_id", "_th", "cls").join(known, "cls", "left").select("_id", "_th", F.coalesce("root", F.xxhash64("_id", "_th")).alias("root"), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row of `docs`; a null doc_id stays null."""
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return groups(docs).select(real("_id").alias("doc_id"), real("class_id").alias("class_id"), "n_links", "n_copies")


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group: the one with the least doc_id (of equal ids, the least text hash)."""
    found = groups(docs)
    first = found.groupBy("root").agg(F.min(F.struct("_id", "_th")).alias("f"))
    kept = first.select(F.col("f._id").alias("_id"), F.col("f._th").alias("_th"))
    repeated = found.groupBy("_id", "_th").count().where("count > 1").select("_id", "_th", F.lit(True).alias("_again"))
    kept = stage(kept.join(repeated, ["_id", "_th"], "left"))
    i, th, again = fresh(docs, "_id", "_th", "_again")
    rows = docs.withColumns(dict(zip((i, th), _key(), strict=True))).join(kept.withColumnsRenamed({"_id": i, "_th": th, "_again": again}), [i, th])
    once = rows.where(F.col(again).isNull()).unionByName(rows.where(F.col(again)).dropDuplicates([i, th]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


#: All pairs by shared shingles; what the join finds with probability RECALL a pair, SQL finds always.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS g FROM d),
c AS (SELECT g, min(doc_id) AS rep, count(*) AS n_copies, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT rep, n, unnest(g) AS t FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.t = b.t AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
m AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT s.doc_id, coalesce(m.class_id, s.doc_id) AS class_id, coalesce(l.n, 0)::BIGINT AS n_links, coalesce(c.n_copies, 1)::BIGINT AS n_copies
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN m ON m.a = c.rep LEFT JOIN l ON l.a = c.rep
"""
