"""Line dedup by content-defined chunks of lines.

Every line has a hash; a rolling hash over the last WINDOW line hashes of the open chunk closes it wherever its
value modulo MODULUS is 0, so that boundaries depend on the lines before them and an insertion shifts none but
its neighbours.  Chunks of fewer than CHUNK_WORDS words (blank lines, brackets) are not compared.  A line of at
least LONG_WORDS words is a chunk of its own, by its content alone.
Passages are chunks too: from every line the shortest run of two lines or more with PASSAGE_WORDS words that
begins there, and the one that ends there.  They overlap and depend on no line outside them, so that every
line of a repeated run of that length is in one of them, whatever is around the run.

Chunks of two lines or more, and such long lines, are compared across the corpus: by hash at first, then
byte by byte with the first occurrence (least doc_id, then position); neighbouring chunks with neighbouring
first occurrences are compared as one run.  A chunk that is equal is removed, together with the lines before and
after it that equal those of the first occurrence, as far as the next chunk that goes for its own sake and as
far as they have fewer than PASSAGE_WORDS words (with more they would be a passage themselves).

Defined results: null and empty texts stay as they are; rows equal in doc_id and text are one document and
are treated alike; a chunk repeated inside one document stays at its first place, and places of one chunk
that overlap there count as one; a document may lose all
its lines and then has the empty text; a null doc_id counts as the least id; an empty table has no rows;
columns of the table named lines_removed, lines_kept or chars_removed are replaced, all others are kept as they are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm.common import fresh

WINDOW = 2
MODULUS = 2
LONG_WORDS = 50
CHUNK_WORDS = 4
#: Words of a passage of two lines or more.
PASSAGE_WORDS = 16
#: Bytes of text in an output batch, more or less.
BATCH_BYTES = 4 << 20
_NO_ID = -(1 << 63)
_MASK = (1 << 64) - 1
#: Beyond the last line of any text.
_FAR = (1 << 31) - 1


def _passages(words: list[int]) -> set[tuple[int, int]]:
    """(first line, end) of the shortest passages that begin or end at each line, by the words of the lines."""
    at = [i for i, w in enumerate(words) if w]
    total, found = [0, *accumulate(words[i] for i in at)], set()
    for k in range(len(at)):
        end = max(k + 2, bisect_left(total, total[k] + PASSAGE_WORDS))
        begin = min(k - 1, bisect_right(total, total[k + 1] - PASSAGE_WORDS) - 1)
        if end <= len(at):
            found.add((at[k], at[end - 1] + 1))
        if begin >= 0:
            found.add((at[begin], at[k] + 1))
    # two long lines are chunks already
    return {(a, b) for a, b in found if b - a > 2 or min(words[a:b]) < LONG_WORDS}


def chunks(text: str) -> list[tuple[int, int, int]]:
    """(first line, lines, hash) of the chunks of `text` that are compared."""
    raw = text.encode("utf-8", "surrogatepass")
    lines, words = raw.split(b"\n"), [len(line.split()) for line in text.split("\n")]
    starts = [0, *accumulate(len(line) + 1 for line in lines)]
    found, start, hashes = _passages(words), 0, []

    def close(end: int) -> None:
        nonlocal start
        if end - start > 1 and sum(words[start:end]) >= CHUNK_WORDS:
            found.add((start, end))
        start = end

    for i, line in enumerate(lines):
        hashes.append(xxhash.xxh64_intdigest(line))
        if words[i] >= LONG_WORDS:
            close(i)
            found.add((i, i + 1))
            start = i + 1
            continue
        rolled = 0
        for h in hashes[max(start, i - WINDOW + 1) :]:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & _MASK
        if i - start + 1 >= WINDOW and (rolled >> 32) % MODULUS == 0:
            close(i + 1)
    close(len(lines))
    out, ends = [], {}  # ends: where the last place of a hash ends
    for a, b in sorted(found):
        h = xxhash.xxh3_64_intdigest(raw[starts[a] : starts[b] - 1])
        if ends.get(h, 0) <= a:
            ends[h] = b
            out.append((a, b - a, h))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _key() -> tuple:
    """What rows are known by: doc_id and the hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), F.xxhash64("text")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumns(dict(zip(("_id", "_th"), _key(), strict=True)))


def _chunk_table(keyed: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [chunks(t) if t else [] for t in part.column(2).to_pylist()]
                rows = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                flat = [c for f in found for c in f]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array([c[0] for c in flat], pa.int32()), pa.array([c[1] for c in flat], pa.int32()), pa.array([_signed(c[2]) for c in flat], pa.int64())],
                    names=["_id", "_th", "at", "n", "h"],
                )

    return keyed.select("_id", "_th", "text").mapInArrow(run, "_id long, _th long, at int, n int, h long")


def _joined(parts: list[dict]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(from, to, low, high, _id, _th, at) of the runs of `parts` (at, n, f) of one document that go.

    A run is of touching parts whose first places (_id, _th, at) lie alike; low and high bound its neighbours.
    """
    parts.sort(key=lambda p: (p["at"], p["n"]))
    runs, last, going = [], {}, []
    for p in parts:
        a, b, f = p["at"], p["at"] + p["n"], p["f"]
        if going and a <= going[-1][1]:
            going[-1][1] = max(b, going[-1][1])
        else:
            going.append([a, b])
        run = last.get(key := (f["_id"], f["_th"], f["at"] - a))
        if run and a <= run[1]:
            run[1] = max(b, run[1])
        else:
            last[key] = run = [a, b, f["_id"], f["_th"], f["at"], len(going) - 1]
            runs.append(run)
    out = []
    for a, b, i, th, at, k in runs:
        low = a if a > going[k][0] else going[k - 1][1] if k else 0
        high = b if b < going[k][1] else going[k + 1][0] if k + 1 < len(going) else _FAR
        out.append((a, b, low, high, i, th, at))
    return out


def _places(by_doc: DataFrame) -> DataFrame:
    """_id, _th, h, first, at, n, low, high: each run of `by_doc` (_id, _th, _parts) that goes, and its first place."""
    names = ["_id", "_th", "h", "first", "at", "n", "low", "high"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            rows = []
            for i, th, parts in zip(*[batch.column(c).to_pylist() for c in names[:2] + ["_parts"]], strict=True):
                for a, b, low, high, f_i, f_th, at in _joined(parts):
                    h = xxhash.xxh3_64_intdigest(np.array([f_i, f_th, at, b - a], "<i8").tobytes())
                    rows.append((i, th, _signed(h), False, a, b - a, low, high))
                    rows.append((f_i, f_th, _signed(h), True, at, b - a, 0, _FAR))
            yield _record(rows, names, types)

    return by_doc.mapInArrow(run, "_id long, _th long, h long, first boolean, at int, n int, low int, high int")


def _record(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)


def _bodies(docs: DataFrame) -> DataFrame:
    """The text of each place of `docs` (.., text, _id, _th, _places) with its neighbouring lines."""
    schema = "h long, first boolean, _id long, _th long, at int, n int, body string, before array<string>, after array<string>"
    names = ["h", "first", "_id", "_th", "at", "n", "body", "before", "after"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):
                text, i, th, places = [batch.column(c)[k].as_py() for c in ("text", "_id", "_th", "_places")]
                lines = text.split("\n")
                total = [0, *accumulate(len(line.split()) for line in lines)]
                for p in places:
                    a, b = p["at"], p["at"] + p["n"]
                    # as far as the neighbouring lines are no passage of their own
                    low = max(p["low"], bisect_right(total, total[a] - PASSAGE_WORDS))
                    high = min(p["high"], bisect_left(total, total[b] + PASSAGE_WORDS) - 1)
                    rows.append((p["h"], p["first"], i, th, a, p["n"], "\n".join(lines[a:b]), lines[low:a][::-1], lines[b:high]))
                    size += len(rows[-1][6])
                    if size > BATCH_BYTES:
                        yield _record(rows, names, types)
                        rows, size = [], 0
            yield _record(rows, names, types)

    return docs.mapInArrow(run, schema)


def _same(a: str, b: str):
    """How many leading elements the arrays `a` and `b` share."""
    flags = F.zip_with(F.col(a), F.col(b), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(flags, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def repeated(docs: DataFrame) -> DataFrame:
    """_id, _th, _ranges: the line ranges (from, to) of each document that repeat an earlier place."""
    keyed = _keyed(docs)
    table = _chunk_table(keyed)
    firsts = table.groupBy("h").agg(F.min(F.struct("_id", "_th", "at")).alias("f"), F.count("*").alias("c")).where("c > 1")
    place = F.struct("_id", "_th", "at")
    parts = table.join(firsts, "h").where(place != F.col("f")).select("_id", "_th", F.struct("at", "n", "f").alias("p"))
    by_doc = parts.groupBy("_id", "_th").agg(F.collect_set("p").alias("_parts"))
    places = _places(by_doc).groupBy("_id", "_th").agg(F.collect_set(F.struct("h", "first", "at", "n", "low", "high")).alias("_places"))
    bodies = _bodies(keyed.join(places, ["_id", "_th"]))
    of_first = bodies.where("first").select("h", F.col("body").alias("f_body"), F.col("before").alias("f_before"), F.col("after").alias("f_after")).distinct()
    same = bodies.where("NOT first").join(of_first, "h").where(F.col("body") == F.col("f_body"))
    ranges = same.select("_id", "_th", F.struct((F.col("at") - _same("before", "f_before")).alias("a"), (F.col("at") + F.col("n") + _same("after", "f_after")).alias("b")).alias("r"))
    return ranges.distinct().groupBy("_id", "_th").agg(F.collect_list("r").alias("_ranges"))


def remove(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, ..) without repeated chunks, plus lines_removed, lines_kept and chars_removed (long)."""
    fields = [f for f in docs.schema.fields if f.name not in ("lines_removed", "lines_kept", "chars_removed")]
    own = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    schema = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in ("lines_removed", "lines_kept", "chars_removed")]])
    at = [f.name for f in fields].index("text")

    def run(batches):
        for batch in batches:
            texts, removed, left, less = batch.column(at).to_pylist(), [], [], []
            for k, ranges in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                lines = texts[k].split("\n") if texts[k] else []
                gone = {i for r in ranges or () for i in range(r["a"], r["b"])}
                less.append(sum(len(lines[i]) for i in gone))
                if gone:
                    texts[k] = "\n".join([x for i, x in enumerate(lines) if i not in gone])
                removed.append(len(gone))
                left.append(len(lines) - len(gone))
            columns = list(batch.columns[: len(fields)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.int64()) for c in (removed, left, less)]], names=schema.names)

    i, th, ranges = fresh(own, "_id", "_th", "_ranges")
    found = repeated(own.select("doc_id", "text")).withColumnsRenamed({"_id": i, "_th": th, "_ranges": ranges})
    joined = own.withColumns(dict(zip((i, th), _key(), strict=True))).join(found, [i, th], "left")
    return joined.select(*[F.col(f"`{f.name}`") for f in fields], ranges).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, lines_kept, lines_removed, n_chars and text_sha256 of what is left of every row of `docs`."""
    left = remove(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "lines_kept", "lines_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
