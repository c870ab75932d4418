"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of one and two tokens (three, with order=3) are mixed per bucket of context frequency:

    P(w | v) = l2(b) P2(w | v) + l1(b) P1(w),   l1 + l2 = 1,

where b tells how often the context v (with order=3 also the two tokens u v) occurs in training rows and P1 is
the additive unigram model.  The weights of each bucket come from expectation-maximisation on held-out counts:
every training token is deleted in turn from the counts of its own n-gram and context (leave one out), over all
training documents.  A context that no training row has leaves its share to the shorter ones.

Counts never meet on one machine, and every n-gram of every training row counts, however rare.  Documents are
taken in batches of about BATCH_BYTES of text.  A batch sends each of its distinct n-grams once, as a hash with
its count, to the slot of that hash; a slot adds up what all batches sent and answers each batch.  Slots are
even whatever is frequent, since a batch sends an n-gram once.  The texts meet the answers by batch, where
everything else is worked out.  Hashes of single tokens have 64 bits, those of longer n-grams at least 54.

A batch is named by its contents.  If a task that is run again finds other rows, texts and answers do not match
and the job fails rather than mixing documents.  The driver sees totals and a histogram of at most 2^19 cells.

Tokens are lower-cased (A-Z) runs between ASCII white space, then one end token a text.  Ratios to P1 are kept
in single precision.  Defined results: a null or empty text is its end token; repeated rows are scored row by
row; a null doc_id counts as training text; without training rows all tokens are unknown and scores are those
of no evidence; an empty table has no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import crc_fold, stage

DELTA = 0.1
FOLDS = 10
ORDER = 2
#: Text of a batch, and of all batches together for one slot of each order.
BATCH_BYTES, SLOT_BYTES = 8 << 20, 4 << 20
#: Slots that there are at least.
SLOTS = 64
#: Bits of a longer n-gram's hash that are sent, besides what its slot tells.
BITS = 48
#: Buckets of the counts of contexts of one and two tokens; bins of a likelihood ratio, one to a power of two.
BUCKETS, BINS, LEAST = (16, 10), 52, -44
_END = b"\n"  # no token has white space
_BEGIN = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


def tokens(text: str | None) -> list[bytes]:
    return [*(text.encode("utf-8", "surrogatepass").lower().split() if text else ()), _END]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(29))


class Grams(NamedTuple):
    """The n-grams of some texts: per order the distinct hashes, how often each is in training texts, and per token its n-gram."""

    sizes: np.ndarray
    end: int
    hashes: list[np.ndarray]
    counts: list[np.ndarray]
    at: list[np.ndarray]


def grams(texts: list[str | None], train: np.ndarray, order: int = ORDER) -> Grams:
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    codes, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = tokens(text)
        sizes[i] = len(words)
        codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    words, at = len(numbers), [np.concatenate(codes)]
    hashes = [np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, words)]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for _ in range(1, order):
        # the n-gram of a token is that of the token before, one shorter, and the token; texts begin with one of their own
        before = np.roll(at[-1], 1)
        before[starts] = len(hashes[-1])
        number, distinct = pd.factorize(before * words + at[0])
        longer = np.append(hashes[-1], _BEGIN[len(at) - 1])
        hashes.append(_mixed(longer[distinct // words], hashes[0][distinct % words]))
        at.append(number)
    weight = np.repeat(train, sizes)
    counts = [np.bincount(a[weight], minlength=len(h)) for a, h in zip(at, hashes, strict=True)]
    return Grams(sizes, numbers[_END], hashes, counts, at)


def _small(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 and more follow in eight."""
    return np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _counts(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, "u1", n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", offset=n)
    return out


def _packed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


class Deal(NamedTuple):
    """How hashes of one kind go to slots: by their highest bits, so that sorted hashes come slot by slot."""

    slots: int
    shift: int

    @staticmethod
    def of(kind: int, slots: int) -> Deal:
        return Deal(slots, 0 if kind == 0 else max(0, 64 - BITS - slots.bit_length() + 1))

    def sorted(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of hashes, where each slot begins in it (and the last ends), and the sorted keys."""
        order = np.argsort(hashes)
        keys = hashes[order]
        slot = ((keys >> np.uint64(32)) * np.uint64(self.slots)) >> np.uint64(32)
        return order, np.searchsorted(slot, np.arange(self.slots + 1, dtype=np.uint64)), keys >> np.uint64(self.shift)

    def begin(self, slot: int) -> int:
        """The least key of a slot."""
        return -(-(slot << 32) // self.slots) << 32 >> self.shift

    def coded(self, slot: int, keys: np.ndarray, counts: np.ndarray) -> bytes:
        """Sorted keys as gaps, byte by byte, with their counts."""
        gaps = np.diff(keys, prepend=np.uint64(self.begin(slot)))
        width = max(1, -(-int(gaps.max()).bit_length() // 8))
        return _packed(bytes([width]), len(keys).to_bytes(8, "little"), gaps.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T.tobytes(), _small(counts))

    def decoded(self, slot: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        blob = _unpacked(blob)
        width, n = blob[0], int.from_bytes(blob[1:9], "little")
        gaps = np.zeros((n, 8), "u1")
        gaps[:, :width] = np.frombuffer(blob, "u1", n * width, 9).reshape(width, n).T
        return np.cumsum(gaps.view("<u8")[:, 0], dtype=np.uint64) + np.uint64(self.begin(slot)), _counts(blob[9 + n * width :], n)


def _sent(found: Grams, slots: int) -> Iterator[tuple[int, bytes]]:
    """(slot, what the batch sends to it)."""
    for k, (hashes, counts) in enumerate(zip(found.hashes, found.counts, strict=True)):
        deal = Deal.of(k, slots)
        order, ends, keys = deal.sorted(hashes)
        counts = counts[order]
        for s in range(slots):
            if (lo := ends[s]) < (hi := ends[s + 1]):
                yield k * slots + s, deal.coded(s, keys[lo:hi], counts[lo:hi])


def _batches(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(name, rows) for batches of about BATCH_BYTES of text; the same rows have the same name."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // BATCH_BYTES)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if hi > lo:
                part, name = batch.slice(lo, hi - lo), xxhash.xxh64()
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    name.update(f"\n{i} {text is None} ".encode())
                    name.update((text or "").encode("utf-8", "surrogatepass"))
                yield name.intdigest() >> 1, part


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, types, strict=True)], names=names.split())


def _answers(docs: DataFrame, slots: int, order: int) -> DataFrame:
    """batch, slot, blob: what each slot answers each batch; as batch -1 its tokens and distinct tokens in training rows."""

    def deal(batches):
        for name, part in _batches(batches):
            found = grams(part.column(1).to_pylist(), ~part.column(2).to_numpy(zero_copy_only=False), order)
            rows = [(slot, name, blob) for slot, blob in _sent(found, slots)]
            for lo in range(0, len(rows), 4096):
                yield _rows(rows[lo : lo + 4096], "slot batch blob")

    def count(key, table):
        slot, names = key[0].as_py(), table.column("batch").to_pylist()
        deal = Deal.of(slot // slots, slots)
        got = [deal.decoded(slot % slots, b) for b in table.column("blob").to_pylist()]
        number, distinct = pd.factorize(np.concatenate([k for k, _ in got]))
        every = np.bincount(number, weights=np.concatenate([c for _, c in got]), minlength=len(distinct)).astype(np.int64)
        rows, at = [], 0
        for name, (keys, _) in zip(names, got, strict=True):
            rows.append((name, slot, _packed(_small(every[number[at : at + len(keys)]]))))
            at += len(keys)
        if slot < slots:
            rows.append((-1, slot, np.array([every.sum(), np.count_nonzero(every)], "<i8").tobytes()))
        return pa.Table.from_batches([_rows(rows, "batch slot blob")])

    return docs.mapInArrow(deal, "slot long, batch long, blob binary").groupBy("slot").applyInArrow(count, "batch long, slot long, blob binary")


def _texts(docs: DataFrame) -> DataFrame:
    """batch, slot -1, blob: the rows of each batch."""

    def run(batches):
        for name, part in _batches(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            yield _rows([(name, -1, _packed(sink.getvalue()))], "batch slot blob")

    return docs.mapInArrow(run, "batch long, slot long, blob binary")


def bucket(counts: np.ndarray, order: int) -> np.ndarray:
    """The bucket of contexts of `order` tokens that occur so often: 0 to 3 themselves, then powers of two."""
    small = np.log2(np.maximum(counts, 1)).astype(np.int64) + 2
    return np.minimum(np.where(counts < 4, counts, small), BUCKETS[order - 1] - 1)


def bin_of(ratio: np.ndarray) -> np.ndarray:
    """The histogram bin of a ratio, the first for 0."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.floor(np.log2(ratio)) - LEAST, 1, BINS - 1), 0).astype(np.int64)


def ratio_of(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > 0, 2.0 ** (bins + LEAST + 0.5), 0.0)


_GATHERED = (
    "batch long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, "
    "bucket binary, ratios binary, cell array<int>, times array<long>, tokens long, types long"
)


def _gathered(docs: DataFrame, slots: int, order: int) -> DataFrame:
    """Per batch: its documents, P1-relative estimates of each token (without the total), and held-out counts per cell."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(docs.sparkSession.createDataFrame([], _GATHERED).schema)

    def gather(key, table):
        slot, blobs = table.column("slot").to_pylist(), table.column("blob").to_pylist()
        row, times = dict.fromkeys(target.names), 1
        row["batch"] = key[0].as_py()
        if row["batch"] < 0:
            total = np.stack([np.frombuffer(b, "<i8") for b in blobs]).sum(0)
            row["tokens"], row["types"] = total.tolist()
        else:
            row |= _estimates(dict(zip(slot, blobs, strict=True)), slots, order)
            times = slot.count(-1)  # batches with the same rows have one name and the same answers
        return pa.Table.from_pylist([row] * times, schema=target)

    return _answers(docs, slots, order).unionByName(_texts(docs)).groupBy("batch").applyInArrow(gather, _GATHERED)


def _estimates(got: dict[int, bytes], slots: int, order: int) -> dict:
    """The columns of one batch from its rows (slot -1) and the answers of the slots."""
    if -1 not in got or len(got) == 1:
        raise RuntimeError("texts and answers of a batch do not match: its rows were not the same when they were read again")
    part = pa.ipc.open_stream(_unpacked(got.pop(-1))).read_all()
    held = part.column(2).to_numpy()
    found = grams(part.column(1).to_pylist(), ~held, order)
    counts = []
    for k, hashes in enumerate(found.hashes):
        places, ends, _ = Deal.of(k, slots).sorted(hashes)
        own = np.zeros(len(hashes), np.int64)
        own[places] = np.concatenate([_counts(_unpacked(got[k * slots + s]), int(ends[s + 1] - ends[s])) for s in range(slots) if ends[s + 1] > ends[s]])
        counts.append(own)
    starts = np.concatenate([[0], np.cumsum(found.sizes)[:-1]])
    word = counts[0][found.at[0]] + DELTA
    is_train = np.repeat(~held, found.sizes)
    buckets, ratios, left = np.zeros(len(word), np.int64), [], []
    for k in range(1, order):
        context = np.roll(counts[k - 1][found.at[k - 1]], 1)
        context[starts] = counts[0][found.end]  # as many texts begin as end
        own = counts[k][found.at[k]]
        ratios.append((own / np.maximum(context, 1) / word).astype("<f4"))
        with np.errstate(divide="ignore", invalid="ignore"):
            left.append(np.where(context > 1, (own - 1) / np.maximum(context - 1, 1), 0.0)[is_train] / word[is_train])
        buckets = buckets + bucket(context, k) * math.prod(BUCKETS[: k - 1])
    cell = buckets[is_train]
    for ratio in reversed(left):
        cell = cell * BINS + bin_of(ratio)
    cells, times = np.unique(cell, return_counts=True)
    return {
        "doc_id": part.column(0).to_pylist(), "held_out": held.tolist(), "n_tokens": found.sizes.tolist(),
        "n_known": np.add.reduceat(counts[0][found.at[0]] > 0, starts, dtype=np.int64).tolist(), "base": np.add.reduceat(np.log10(word), starts).tolist(),
        "bucket": buckets.astype("u1").tobytes(), "ratios": np.concatenate(ratios).tobytes(), "cell": cells.tolist(), "times": times.tolist(),
    }


def weights(cells: np.ndarray, times: np.ndarray, total: float, order: int = ORDER, rounds: int = 60) -> np.ndarray:
    """(l1, l2, ..) per bucket, by expectation-maximisation on held-out counts per cell (bucket, then bins, the longest first)."""
    n = math.prod(BUCKETS[: order - 1])
    own = cells // BINS ** (order - 1)
    ratio = np.stack([np.ones(len(cells)), *[ratio_of(cells // BINS ** (k - 1) % BINS) * total for k in range(1, order)]], 1)
    mix = np.full((n, order), 1 / order)
    for _ in range(rounds):
        share = mix[own] * ratio
        share *= (times / share.sum(1))[:, None]
        sums = np.stack([np.bincount(own, weights=s, minlength=n) for s in share.T], 1).astype(float)
        sums[:, 0] += 1.0  # a bucket without evidence has the shortest estimate
        mix = sums / sums.sum(1)[:, None]
    if order == 3:
        # a context of two tokens that is unseen is like one that is unseen once its only place is deleted
        by = mix.reshape(BUCKETS[1], BUCKETS[0], 3)
        by[0] = by[1]
        by[0, :, 1], by[0, :, 2] = by[0, :, 1] + by[0, :, 2], 0.0
    mix[:: BUCKETS[0]] = [1.0, *[0.0] * (order - 1)]
    return mix


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    found = stage(_gathered(docs, max(SLOTS, math.ceil(size / SLOT_BYTES)), order), compression="zstd")
    totals = found.where("batch < 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    total = totals["n"] + DELTA * (totals["v"] + 1)
    histogram = found.where("batch >= 0").select(F.explode(F.arrays_zip("cell", "times")).alias("x")).groupBy("x.cell").agg(F.sum("x.times").alias("n")).toPandas()
    learned = weights(histogram["cell"].to_numpy(np.int64), histogram["n"].to_numpy(np.float64), total, order)
    shared, n = docs.sparkSession.sparkContext.broadcast(learned), totals["n"]

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                mix, sizes = shared.value[np.frombuffer(row["bucket"], "u1")], np.array(row["n_tokens"])
                ratios = np.frombuffer(row["ratios"], "<f4").reshape(order - 1, -1)
                gain = np.log10(mix[:, 0] + total * sum(mix[:, k] * ratios[k - 1] for k in range(1, order)))
                base = np.array(row["base"]) - sizes * math.log10(total)
                gained = np.add.reduceat(gain, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"]), pa.array(sizes), pa.array(row["n_known"], pa.int64()), pa.array(np.full(len(sizes), n)), pa.array(base), pa.array(base + gained)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = found.where("batch >= 0").select("doc_id", "held_out", "n_tokens", "n_known", "base", "bucket", "ratios")
    return rows.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
