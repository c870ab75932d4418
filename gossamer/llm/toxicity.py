"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings of four and five letters, hashed into BUCKETS.  A factorization machine
learns a weight per bucket and a vector of FACTORS numbers per bucket, whose inner products are the weights of
pairs (an insult together with a group, say), which additive weights cannot express.

A bucket enters with a value between 0 and 1 that follows its evidence, so that what is frequent but idle does
not drown the rest: the standard errors by which its document frequencies differ between the classes, or by
which a pair of words near each other does so beyond both of its words.  Words that are neutral alone and not
together therefore reach the machine, too.  Values below LEAST count as 0.

The classifier is fitted on at most SAMPLE labelled ids (a documented bound: those with the smallest hash of
doc_id), one text each, and scores whole texts of all rows.

Defined results: null and empty texts get the score of no terms; repeated labels of one id count as their
largest, null labels not at all; of rows that share a labelled id the text with the least hash is learned from;
without labels of both classes every score is the share of toxic ones (from 0.001 to 0.999), 0.001 without labels; an empty table has no rows; a column
named score is replaced, all others are kept as they are.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm.common import claim, crc_fold, stage

BUCKETS = 1 << 18
#: Buckets of pairs of words, and how far apart such words are at most.
PAIRS, NEAR = 1 << 22, 5
FACTORS = 8
SAMPLE = 24_000
#: Standard errors at which a bucket, or a pair beyond its words, counts half; pairs below STRONG are left alone.
HALF, HALF_PAIR, STRONG = 4.0, 6.0, 6.0
LEAST = 0.02
THRESHOLD = 0.3
EPOCHS = 12
#: Buckets that are added up together.
SEGMENT = 1 << 16
#: Words that a worker keeps with their buckets, about 200 bytes each; longer words are not kept.
MEMO_ENTRIES, MEMO_LETTERS = 200_000, 40
_WORD = re.compile(r"[^\W\d_]+")


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def _buckets(word: str) -> tuple[int, ...]:
    """The bucket of a word, then those of its beginnings."""
    return (_bucket(word), _bucket(f"4{word[:4]}"), _bucket(f"5{word[:5]}")) if len(word) > 5 else (_bucket(word), _bucket(f"4{word[:4]}"))


class _Words(dict):
    """word -> what `make` tells of it, kept for short words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.make(word)
        if len(word) <= MEMO_LETTERS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = found
        return found


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair bucket and both words (by bucket) of every two words near each other."""
    a, b = [np.concatenate(x) if len(words) else words for x in zip(*[(words[: max(0, len(words) - d)], words[d:]) for d in range(1, NEAR + 1)], strict=True)]
    low, high = np.minimum(a, b), np.maximum(a, b)
    mixed = (low.astype(np.uint64) * np.uint64(BUCKETS) + high.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(42)).astype(np.int64), low, high


class Machine(NamedTuple):
    """A second-order factorization machine over the buckets that have a value."""

    buckets: np.ndarray
    values: np.ndarray
    bias: float
    linear: np.ndarray
    pairs: np.ndarray

    def features(self) -> _Words:
        """word -> the features it switches on."""
        at = dict(zip(self.buckets.tolist(), range(len(self.buckets)), strict=True))
        return _Words(lambda word: tuple(at[b] for b in _buckets(word) if b in at))

    @staticmethod
    def active(features: _Words, texts: list[str | None]) -> list[np.ndarray]:
        """The features of each text, each once."""
        return [np.array(sorted({f for w in set(_words(t)) for f in features[w]}), np.int32) for t in texts]

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(_logits(_Rows(rows, self.values), self.bias, self.linear, self.pairs)[0])


class _Rows:
    """Rows of features, one after the other, with their values."""

    def __init__(self, rows: list[np.ndarray], values: np.ndarray):
        self.n = len(rows)
        self.at = np.concatenate(rows)
        self.own = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.x = values[self.at]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _by_row(rows: _Rows, x: np.ndarray) -> np.ndarray:
    return np.bincount(rows.own, weights=x, minlength=rows.n)


def _logits(rows: _Rows, bias: float, linear: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logit of each row, the sums of its features' factors, and those factors."""
    own = pairs[rows.at] * rows.x[:, None]
    sums = np.stack([_by_row(rows, own[:, k]) for k in range(pairs.shape[1])], 1)
    return bias + _by_row(rows, linear[rows.at] * rows.x) + 0.5 * ((sums**2).sum(1) - _by_row(rows, (own**2).sum(1))), sums, own


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, values: np.ndarray, rate: float = 0.1, decay: float = 2e-5, seed: int = 7) -> Machine:
    """A machine fitted by stochastic gradients with steps of their own for every weight."""
    n = len(buckets)
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    bias, linear, pairs = float(np.log(share / (1 - share))), np.zeros(n), np.random.default_rng(seed).normal(0, 0.03, (n, FACTORS))
    if n and len(labels) and labels.min() < labels.max():
        past = [1e-6, np.full(n, 1e-6), np.full((n, FACTORS), 1e-6)]
        order = np.random.default_rng(seed + 4)
        for _ in range(EPOCHS):
            shuffled = order.permutation(len(rows))
            for lo in range(0, len(rows), 256):
                at = shuffled[lo : lo + 256]
                some = _Rows([rows[i] for i in at], values)
                z, sums, own = _logits(some, bias, linear, pairs)
                miss = (_sigmoid(z) - labels[at]) / len(at)
                weight = miss[some.own] * some.x
                of = lambda x, f=some.at: np.bincount(f, weights=x, minlength=n)
                through = np.stack([of(weight * (sums[some.own, k] - own[:, k])) for k in range(FACTORS)], 1)
                slopes = [float(miss.sum()), of(weight) + decay * linear, through + decay * pairs]
                past = [p + g * g for p, g in zip(past, slopes, strict=True)]
                steps = [rate * g / np.sqrt(p) for p, g in zip(past, slopes, strict=True)]
                bias, linear, pairs = bias - steps[0], linear - steps[1], pairs - steps[2]
    return Machine(buckets, values, bias, linear, pairs)


def _errors(seen: np.ndarray, clean: int, toxic: int) -> np.ndarray:
    """Standard errors between the shares of toxic (row 1) and clean texts (row 0) that have each bucket."""
    share = seen.sum(0) / (clean + toxic)
    return (seen[1] / toxic - seen[0] / clean) / np.sqrt(np.maximum(share * (1.000001 - share), 1e-12) * (1 / toxic + 1 / clean))


def _differences(texts: DataFrame, clean: int, toxic: int) -> tuple[np.ndarray, dict[int, float]]:
    """The standard errors of every bucket, and of the strong pair buckets."""

    def count(batches):
        memo, seen, pairs = _Words(_buckets), np.zeros((2, BUCKETS), np.int32), np.zeros((2, PAIRS), np.int32)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [memo[w] for w in _words(text)]
                seen[int(y > 0), list({b for f in found for b in f})] += 1
                pairs[int(y > 0), np.unique(_pairs(np.array([f[0] for f in found], np.int64))[0])] += 1
        for kind, table in enumerate((seen, pairs)):
            for lo in range(0, table.shape[1], SEGMENT):
                if (part := table[:, lo : lo + SEGMENT]).any():
                    at = np.flatnonzero(part.any(0))
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([lo], pa.int64()), pa.array([at.astype("<u2").tobytes()]), pa.array([part[:, at].astype("<i4").tobytes()])], names=["kind", "low", "at", "seen"])

    def add(key, table):
        kind, low = (k.as_py() for k in key)
        total = np.zeros((2, SEGMENT), np.int64)
        for at, seen in zip(table.column("at").to_pylist(), table.column("seen").to_pylist(), strict=True):
            total[:, np.frombuffer(at, "<u2")] += np.frombuffer(seen, "<i4").reshape(2, -1)
        z = _errors(total, clean, toxic)
        at = np.flatnonzero(total.any(0) if kind == 0 else np.abs(z) >= STRONG)
        return pa.table({"kind": pa.array([kind], pa.int32()), "at": pa.array([(low + at).tolist()], pa.list_(pa.int64())), "z": pa.array([z[at].tolist()], pa.list_(pa.float64()))})

    parts = texts.mapInArrow(count, "kind int, low long, at binary, seen binary").groupBy("kind", "low").applyInArrow(add, "kind int, at array<long>, z array<double>")
    z, strong = np.zeros(BUCKETS), {}
    for r in parts.collect():
        if r["kind"] == 0:
            z[r["at"]] = r["z"]
        else:
            strong |= dict(zip(r["at"], r["z"], strict=True))
    return z, strong


def _beyond(texts: DataFrame, z: np.ndarray, strong: dict[int, float]) -> np.ndarray:
    """For each bucket the most standard errors by which a pair of its words differs beyond both words."""
    out = np.zeros(BUCKETS)
    if not strong:
        return out
    keys = np.array(sorted(strong))
    shared = texts.sparkSession.sparkContext.broadcast((np.abs(z), keys, np.abs([strong[k] for k in keys.tolist()])))

    def run(batches):
        (alone, keys, together), memo, most = shared.value, _Words(_buckets), np.zeros(BUCKETS)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                pair, a, b = _pairs(np.array([memo[w][0] for w in _words(text)], np.int64))
                place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                hit = keys[place] == pair
                a, b, more = a[hit], b[hit], together[place[hit]] - np.maximum(alone[a[hit]], alone[b[hit]])
                np.maximum.at(most, a, more)
                np.maximum.at(most, b, more)
        at = np.flatnonzero(most > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(most[at])], names=["bucket", "more"])

    for r in texts.mapInArrow(run, "bucket long, more double").groupBy("bucket").agg(F.max("more").alias("more")).collect():
        out[r["bucket"]] = r["more"]
    return out


def _value(errors: np.ndarray, half: float) -> np.ndarray:
    return errors**4 / (errors**4 + half**4)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine fitted on labelled rows outside the held-out quarter."""
    wanted = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    wanted = stage(wanted.where(crc_fold(F.col("doc_id"), 4) != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    found = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    texts = stage(found.select(F.col("t.text").alias("text"), "toxic", "doc_id"))
    sizes = {bool(r[0]): r[1] for r in texts.groupBy(F.col("toxic") > 0).count().collect()}
    clean, toxic = sizes.get(False, 0), sizes.get(True, 0)
    if not clean or not toxic:
        return fit([], np.repeat([0.0, 1.0], [clean, toxic]), np.zeros(0, np.int64), np.zeros(0))
    z, strong = _differences(texts, clean, toxic)
    values = np.maximum(_value(np.abs(z), HALF), _value(_beyond(texts, z, strong), HALF_PAIR))
    buckets = np.flatnonzero(values >= LEAST)
    machine = Machine(buckets, values[buckets], 0.0, np.zeros(0), np.zeros(0))

    def active(batches):
        features = machine.features()
        for batch in batches:
            on = machine.active(features, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([o.tobytes() for o in on], pa.binary()), batch.column(1), batch.column(2)], names=["on", "toxic", "doc_id"])

    rows = texts.mapInArrow(active, f"on binary, toxic int, doc_id {texts.schema['doc_id'].dataType.simpleString()}").toArrow().sort_by("doc_id")
    # all features in one array, of which a row is a part: some 50 MB for SAMPLE texts of the usual length
    column = rows.column("on").combine_chunks()
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
    on = np.split(np.frombuffer(column.buffers()[2], np.int32), ends[1:-1])
    return fit(on, (rows.column("toxic").to_numpy() > 0).astype(float), machine.buckets, machine.values)


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """`docs` with the column score, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name != "score"]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    at = [f.name for f in fields].index("text")

    def run(batches):
        claim("toxicity")
        machine = shared.value
        features = machine.features()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = machine.active(features, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(machine.probability(rows), pa.float64())], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
