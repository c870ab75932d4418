"""Benchmark decontamination: training words inside n-word windows of test items are found and removed.

The windows of the test items are broadcast as one hash table if they are at most MAX_ROWS (window, item) rows;
then documents are read once and nothing is shuffled.  A larger benchmark is broadcast as a bitmap of hashes
(SIEVE_BITS bits whatever its size): places whose bit is set are joined with the windows, word by word, and
what was found is brought back to its document.  Either way every hash hit is verified by its words.

Defined results: null and empty texts have no words and no hits; an item of fewer words than a window is
one window; items without words, and null item ids, are never listed; a text that repeats a window is hit
at each place; repeated rows are handled row by row; an empty table, or an empty benchmark, has no hits;
columns of the table that find() adds (_hits, _items, _words) are replaced by its own, all others, and all
columns given to remove_spans(), are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm.common import Memo, arrow_map, fresh, normal_words, stage

WINDOW = 10
#: (window, item) rows of a broadcast hash table, at most about 300 bytes each.
MAX_ROWS = 200_000
#: Bits of the bitmap that stands for a larger benchmark: 32 MB.
SIEVE_BITS = 28
_SEGMENT = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
HITS, ITEMS, WORDS = "_hits", "_items", "_words"


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct (words, item) rows of `benchmark` (item_id, text)."""

    def rows(columns):
        items, texts = columns
        out = [(" ".join([w.decode("utf-8", "replace") for w in ws[i : i + n]]), item) for item, t in zip(items, texts, strict=True) if (ws := normal_words(t)) for i in range(max(1, len(ws) - n + 1))]
        yield {"words": [w for w, _ in out], "item": [i for _, i in out]}

    return arrow_map(benchmark.select(F.col("item_id").cast("string"), "text"), "words string, item string", rows).distinct()


class _Index:
    """Hash tables of windows."""

    def __init__(self, rows: list[tuple[str, str | None]]):
        self.items: dict[tuple[bytes, ...], list[str]] = {}
        for words, item in rows:
            found = self.items.setdefault(tuple(words.encode().split(b" ")), [])
            if item is not None:
                found.append(item)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in self.items for w in ws}), 1)}
        by_length: dict[int, list] = {}
        for words in self.items:
            by_length.setdefault(len(words), []).append([self.vocabulary[w] for w in words])
        self.hashes = {n: np.unique(self._hash(np.array(v, dtype=np.uint64).T)) for n, v in by_length.items()}

    @staticmethod
    def _hash(columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            total = (total ^ c) * _ODD
            total ^= total >> np.uint64(29)
        return total

    def scan(self, documents: list[list[bytes]]) -> list[tuple[set[int], set[str]]]:
        """Per document the positions of its hit words and the items that hit them."""
        found: list[tuple[set[int], set[str]]] = [(set(), set()) for _ in documents]
        get = self.vocabulary.get
        flat = np.fromiter((get(w, 0) for ws in documents for w in (*ws, b"")), dtype=np.uint64, count=sum(map(len, documents)) + len(documents))
        starts = np.cumsum([0, *(len(ws) + 1 for ws in documents)])
        gaps = np.concatenate([[0], np.cumsum(flat == 0)])
        for n, known in self.hashes.items():
            if len(flat) < n:
                continue
            at = np.flatnonzero(gaps[n:] == gaps[:-n])
            hashed = self._hash([flat[at + j] for j in range(n)])
            near = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
            for i in at[known[near] == hashed].tolist():
                d = int(np.searchsorted(starts, i, side="right")) - 1
                lo = i - int(starts[d])
                if (items := self.items.get(tuple(documents[d][lo : lo + n]))) is not None:
                    found[d][0].update(range(lo, lo + n))
                    found[d][1].update(items)
        return found


def _by_table(docs: DataFrame, table: DataFrame, names: list[str], finish=None) -> DataFrame:
    """One narrow pass with all windows broadcast; `finish` is applied to its batches."""
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in table.collect()])
    schema, at = _schema(docs, names), docs.columns.index("text")

    def run(batches):
        index = _Index(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [normal_words(t) for t in part.column(at).to_pylist()]
                done = _with_hits(part, index.scan(texts), texts, schema.names)
                yield finish(done) if finish else done

    return docs.mapInArrow(run, docs.schema if finish else schema)


def _schema(docs: DataFrame, names: list[str]) -> T.StructType:
    kinds = [T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()), T.LongType()]
    return T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])


def _with_hits(part: pa.RecordBatch, found: list[tuple[set[int], set[str]]], texts: list[list[bytes]], names: list[str]) -> pa.RecordBatch:
    hits, items = [sorted(h) for h, _ in found], [sorted(i) for _, i in found]
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array([len(t) for t in texts], pa.int64())], names=names)


_HASHES = Memo(xxhash.xxh64_intdigest)


def _window_hashes(words: list[bytes], n: int) -> np.ndarray:
    """The hash of every run of n words, reduced to the bits of the sieve."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    return _Index._hash([h[j : len(h) - n + 1 + j] for j in range(n)]) >> np.uint64(64 - SIEVE_BITS) if len(h) >= n else np.zeros(0, np.uint64)


def _sieve(table: DataFrame) -> tuple[list[int], np.ndarray]:
    """The lengths of windows, and the bitmap of their hashes."""

    def mark(batches):
        for batch in batches:
            marks: dict[int, set[int]] = {}
            for words in batch.column(0).to_pylist():
                split = words.encode().split(b" ")
                bit = int(_window_hashes(split, len(split))[0])
                marks.setdefault(bit // _SEGMENT, set()).add(bit % _SEGMENT)
            yield pa.RecordBatch.from_arrays([pa.array(list(marks), pa.int64()), pa.array([np.array(sorted(m), "<u4").tobytes() for m in marks.values()], pa.binary())], names=["segment", "marks"])

    def join(key, rows):
        bits = np.zeros(_SEGMENT, bool)
        for m in rows.column("marks").to_pylist():
            bits[np.frombuffer(m, "<u4")] = True
        return pa.table({"segment": pa.array([key[0].as_py()]), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    lengths = sorted(r[0] for r in table.select(F.size(F.split("words", " "))).distinct().collect())
    sieve = np.zeros((1 << SIEVE_BITS) // 8, np.uint8)
    for r in table.select("words").mapInArrow(mark, "segment long, marks binary").groupBy("segment").applyInArrow(join, "segment long, bits binary").collect():
        lo = r["segment"] * _SEGMENT // 8
        sieve[lo : lo + _SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
    return lengths, sieve


def _by_join(docs: DataFrame, table: DataFrame, names: list[str], finish=None) -> DataFrame:
    """Places that the sieve lets through are joined with the windows, their finds with the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(table))

    def places(batches):
        lengths, sieve = shared.value
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normal_words(text)
                at, found = [], []
                for n in lengths:
                    bit = _window_hashes(words, n)
                    for i in np.flatnonzero(sieve[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1).tolist():
                        at.append(i)
                        found.append(b" ".join(words[i : i + n]).decode("utf-8", "replace"))
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(found, pa.string())], names=["key", "at", "words"])

    # equal texts have equal hits: they are looked at once for each, and found by their digest
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    seen = docs.select(key.alias("key"), "text").mapInArrow(places, "key binary, at int, words string").distinct()
    own = F.sequence(F.col("at"), F.col("at") + F.size(F.split("words", " ")) - 1)
    hits = seen.join(table, "words").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(own)))).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    digest, hit, item = fresh(docs, "_digest", "_at", "_item")
    joined = docs.withColumn(digest, key).join(hits.withColumnsRenamed({"key": digest, "hits": hit, "items": item}), digest, "left").select(*[F.col(f"`{c}`") for c in docs.columns], hit, item)
    schema, at = _schema(docs, names), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [normal_words(t) for t in batch.column(at).to_pylist()]
            found = [(set(h or ()), set(i or ())) for h, i in zip(*[batch.column(batch.num_columns - k).to_pylist() for k in (2, 1)], strict=True)]
            part = pa.RecordBatch.from_arrays(batch.columns[:-2], names=docs_columns)
            done = _with_hits(part, found, texts, schema.names)
            yield finish(done) if finish else done

    docs_columns = docs.columns
    return joined.mapInArrow(run, docs.schema if finish else schema)


def _found(docs: DataFrame, benchmark: DataFrame, n: int, max_rows: int, names: list[str], finish=None) -> DataFrame:
    table = stage(windows(benchmark, n))
    return (_by_table if table.count() <= max_rows else _by_join)(docs, table, names, finish)


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_rows: int = MAX_ROWS) -> DataFrame:
    """`docs` with the positions of hit words (_hits), the hitting items (_items) and the word count (_words)."""
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (HITS, ITEMS, WORDS)])
    return _found(own, benchmark, n, max_rows, [HITS, ITEMS, WORDS])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of `docs`."""
    found = find(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col(WORDS).alias("n_words"),
        F.size(HITS).cast("long").alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ITEMS), ","), 256).alias("items_sha256"),
        (F.size(HITS) > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, most: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """`docs` without the hit spans; a document of which more than `most` of the words are hit goes as a whole.

    A span runs from the first to the last character of a run of hit words; all other characters stay.
    """
    import re

    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def without(text: str, hit: set[int]) -> str:
        raw, out, end = text.encode("utf-8", "surrogatepass"), [], 0
        spans = [m.span() for m in word.finditer(raw)]
        for p in sorted(hit):
            if p - 1 not in hit:
                out.append(raw[end : spans[p][0]])
            end = spans[p][1]
        return b"".join([*out, raw[end:]]).decode("utf-8", "replace")

    names = fresh(docs, HITS, ITEMS, WORDS)

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits, words, texts = (batch.column(c).to_pylist() for c in (names[0], names[2], "text"))
        kept = [k for k in range(len(hits)) if len(hits[k]) <= most * words[k]]
        texts = [without(texts[k], set(hits[k])) if hits[k] else texts[k] for k in kept]
        rest = batch.take(pa.array(kept, pa.int64()))
        left = [c for c in batch.schema.names if c not in names]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else rest.column(c) for c in left], names=left)

    return _found(docs, benchmark, WINDOW, max_rows, names, finish)


_SPLIT = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_SPLIT.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_SPLIT.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i+least(len(w), {WINDOW})-1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w)-{WINDOW - 1}, 1)+1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
