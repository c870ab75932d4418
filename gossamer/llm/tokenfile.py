"""Token ids in binary shards: independent zstandard frames, a trailing seek table, checksums.

A shard is a sequence of zstandard frames, each with whole documents and its own content checksum, then
two skippable frames that any zstandard reader passes over: the document index (per frame: first and last
doc_id, documents, ids) and, last, the seek table of the public seekable format (per frame: compressed
size, decompressed size, low 32 bits of XXH64 of the content; then the number of frames, a descriptor
byte and the magic number).  A reader fetches the tail, then only the frames with requested documents.

Frame content: documents (u32), doc_ids (i64 each), id counts (u64 each), all ids (u32 each), little-endian.

Shards hold consecutive ranges of doc_id.  Tasks that run twice write two files; only the one that the
manifest names counts.  Defined results: null and empty texts have the end id alone; rows of one doc_id
are ordered by the hash of their text; a null doc_id sorts first; rows equal in both may be in several shards;
an empty table has one shard without documents at most; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.bpe import SEPARATORS, _Short, _SPACE, default_tokenizer
from gossamer.llm.common import claim, partitions, shared_dir, stage

END_ID = 2
#: A frame is closed once it holds so many ids.
FRAME_IDS = 1 << 16
#: Text of a shard, more or less; there are as many shards as that takes, and as many as tasks of a shuffle at least.
SHARD_BYTES = 256 << 20
NULL_ID = -(1 << 63)
_INDEX_MAGIC, _TABLE_MAGIC, _FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_SPAN = np.dtype([("first", "<i8"), ("last", "<i8"), ("documents", "<u8"), ("ids", "<u8")])


#: Longer pieces are not kept.
MOST_LETTERS = 64
#: Letters that have one lower-case letter and one spelling, then signs that are tokens of their own.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class _Pieces(_Short):
    """Short pieces with their ids: about 160 bytes each, of which a worker sees one or two million."""

    most = 1_500_000

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > MOST_LETTERS:
            return self.make(piece)
        # capitals and trailing signs do not make a new word for the library
        if (m := _PLAIN.fullmatch(piece)) and (word := m[1].lower()) != piece:
            found = self[word] + (self[m[2]] if m[2] else b"")
            if len(self) >= self.most:
                self.clear()
            self[piece] = found
            return found
        return super().__missing__(piece)


class Encoder:
    """The tokenizers library, asked once per worker for each word between white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = _Pieces(lambda piece: np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes())

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = _SPACE.split(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join(map(self.pieces.__getitem__, pieces))


class ShardWriter:
    def __init__(self, sink):
        self.sink, self.table, self.spans = sink, [], []
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self._clear()

    def _clear(self) -> None:
        self.doc_ids, self.ids, self.held = [], [], 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.ids.append(ids)
        self.held += len(ids) // 4
        if self.held >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if not self.doc_ids:
            return
        n = len(self.doc_ids)
        plain = b"".join([struct.pack("<I", n), np.array(self.doc_ids, "<i8").tobytes(), np.array([len(i) // 4 for i in self.ids], "<u8").tobytes(), *self.ids])
        packed = self.packer.compress(plain)
        self.sink.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.spans.append((self.doc_ids[0], self.doc_ids[-1], n, self.held))
        self._clear()

    def close(self) -> None:
        self.flush()
        index = np.array(self.spans, _SPAN).tobytes()
        self.sink.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        table = np.array(self.table, _ENTRY).tobytes() + struct.pack("<IBI", len(self.table), 0x80, _FOOT_MAGIC)
        self.sink.write(struct.pack("<II", _TABLE_MAGIC, len(table)) + table)


class ShardReader:
    """Random access to one shard; reads the tail at first, frames when asked."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _FOOT_MAGIC:
            raise ValueError("not a shard: its seek table is missing")
        begin = size - 9 - n * _ENTRY.itemsize - 8
        self.table = np.frombuffer(self._at(begin + 8, n * _ENTRY.itemsize), _ENTRY)
        self.spans = np.frombuffer(self._at(begin - n * _SPAN.itemsize, n * _SPAN.itemsize), _SPAN)
        self.offsets = np.concatenate([[0], np.cumsum(self.table["packed"].astype(np.int64))])

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> list[tuple[int, bytes]]:
        entry = self.table[k]
        plain = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(entry["packed"])), max_output_size=int(entry["plain"]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {k} does not match its checksum")
        (n,) = struct.unpack_from("<I", plain)
        doc_ids = np.frombuffer(plain, "<i8", n, 4).tolist()
        ends = 4 + 16 * n + 4 * np.cumsum(np.frombuffer(plain, "<u8", n, 4 + 8 * n)).astype(np.int64)
        starts = [4 + 16 * n, *ends[:-1].tolist()]
        return [(d, plain[a:b]) for d, a, b in zip(doc_ids, starts, ends.tolist(), strict=True)]

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, bytes]]:
        """The requested documents, from the frames that may hold them and no others."""
        for k, span in enumerate(self.spans):
            if any(span["first"] <= d <= span["last"] for d in wanted):
                yield from ((d, ids) for d, ids in self.frame(k) if d in wanted)


def write(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Encodes `docs` (doc_id, text) into shards below `folder`; the manifest has a row per shard.

    Rows: part int, file string, documents long, ids long.  The manifest is as small as the number of shards.
    """
    path = path or default_tokenizer()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.rand(7).alias("deal"))
    # one narrow pass for the size; equal rows are dealt over several shards
    shards = max(partitions(docs.sparkSession), math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SHARD_BYTES))
    rows = rows.repartitionByRange(shards, "doc_id", "tie", "deal").drop("deal").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        from pyspark import TaskContext

        claim("tokenfile")
        encoder, end = _encoder(path), np.array([END_ID], "<u4").tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name, documents, ids = f"part-{part:06d}-{uuid.uuid4().hex}.ztk", 0, 0
        with store.open_output_stream(f"{base}/{name}") as sink:
            writer = ShardWriter(sink)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    some = batch.slice(lo, 256)
                    for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                        coded = encoder.encode(text) + end
                        writer.add(NULL_ID if doc_id is None else doc_id, coded)
                        documents += 1
                        ids += len(coded) // 4
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "documents": [documents], "ids": [ids]})

    return stage(rows.mapInArrow(run, "part int, file string, documents long, ids long"))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary) of every document in the shards, read frame by frame."""
    return _read(manifest, folder, "ids binary", lambda ids: {"ids": ids}, pa.schema([("ids", pa.binary())]))


def _read(manifest: DataFrame, folder: str, columns: str, derive, types: pa.Schema) -> DataFrame:
    shards, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        shards.append((r["file"], start))
        start += r["ids"]
    spark = manifest.sparkSession

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, at = shards[k]
                with store.open_input_file(f"{base}/{name}") as source:
                    reader = ShardReader(source)
                    for f in range(len(reader.table)):
                        rows = reader.frame(f)
                        counts = [len(ids) // 4 for _, ids in rows]
                        starts = at + np.concatenate([[0], np.cumsum(counts)])
                        at = int(starts[-1])
                        own = [derive(ids) for _, ids in rows]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([None if d == NULL_ID else d for d, _ in rows], pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(counts, pa.int64()), *[pa.array([o[t.name] for o in own], t.type) for t in types]],
                            names=["doc_id", "start", "n_tokens", *types.names],
                        )

    n = max(1, len(shards))
    return spark.range(0, len(shards), 1, n).mapInArrow(run, f"doc_id long, start long, n_tokens long, {columns}")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the shards of `docs`, reads them back and returns doc_id, start, n_tokens, ids_crc32."""
    folder = shared_dir(docs.sparkSession)
    manifest = write(docs, folder, path)
    return _read(manifest, folder, "ids_crc32 long", lambda ids: {"ids_crc32": zlib.crc32(ids)}, pa.schema([("ids_crc32", pa.int64())]))
