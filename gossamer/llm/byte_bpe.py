"""Byte-level BPE encoding and decoding by a file of ranks, merged in padded matrices.

Texts are cut by a pattern; pieces that a worker has not met before are put into buckets by length, one padded
matrix of token ids a bucket.  In every round each row merges its leftmost pair of least rank; since every live
row loses exactly one column, removing it packs the matrix.  Ranks of pairs are looked up in an open hash table
of numpy arrays.  Pieces beyond LONGEST_ROW bytes are a matrix of one row each, in which one round merges all
places of the least rank up to the first whose merge makes a pair of lower rank: the same result in fewer rounds.

Defined results: a null or empty text has no ids and decodes to nothing; a piece that is a token as a whole is
that token; repeated rows are encoded alike; an empty table has no rows; columns of the table named ids or
decoded are replaced, all others are kept as they are.  Memory follows the longest text of a slice and the
memo, which holds at most MEMO_ENTRIES pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import MEMO_KEY, arrow_map, claim

#: The widths of the buckets; longer pieces are rows of their own.
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
LONGEST_ROW = WIDTHS[-1]
_BUCKET = [next(w for w in WIDTHS if w >= n) for n in range(LONGEST_ROW + 1)]
#: Cells of a matrix, and letters of the texts encoded at once.
CELLS, SLICE = 1 << 20, 1 << 21
#: Pieces that a worker keeps (about 250 bytes each).
MEMO_ENTRIES = 600_000
NONE = np.int32((1 << 31) - 1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """From pairs of token ids to the id of what they make: open addressing, all lookups of an array at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.bits = max(4, int(len(made) * 4).bit_length())
        self.keys, self.made = np.full(1 << self.bits, _EMPTY), np.full(1 << self.bits, NONE)
        key = self._key(left, right)
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] == _EMPTY
            self.keys[at[todo[free]]] = key[todo[free]]
            placed = self.keys[at[todo]] == key[todo]
            self.made[at[todo[placed]]] = made[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair makes, NONE for pairs that make no token; negative ids are padding."""
        real = (left >= 0) & (right >= 0)
        out = np.full(left.shape, NONE)
        key = self._key(left[real], right[real])
        at = self._slot(key)
        found = self.keys[at]
        wrong = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.keys[at[wrong]]
            wrong = wrong[(found[wrong] != key[wrong]) & (found[wrong] != _EMPTY)]
        out[real] = np.where(found == key, self.made[at], NONE)
        return out


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.tokens[rank] = token
        self.names = list(map(str, range(len(self.tokens))))
        self.bytes = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        halves = [(a, b, rank) for token, rank in self.rank.items() for i in range(1, len(token)) if (a := self.rank.get(token[:i])) is not None and (b := self.rank.get(token[i:])) is not None]
        self.pairs = PairTable(*np.array(halves, dtype=np.int64).reshape(-1, 3).T)
        self.pattern = pattern
        # the library's white space is Unicode's; over ASCII the plain module does the same, only faster
        self.any = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii = re.compile(narrow, re.ASCII) if r"\p" not in narrow else None
        self.known, self._likes = set(), None
        self.memo: dict[str, bytes] = {}

    def likes(self) -> dict[int, str]:
        """For characters that Python's tables do not know: one of the class that the library gives them.

        Asked from the library itself: with tokens of a, 1 or ! and one more byte, a character that stays in one
        piece with that letter begins such a token.
        """
        if self._likes is None:
            import tiktoken

            probes = "a1!"
            ranks = {bytes([b]): b for b in range(256)}
            for p in probes:
                ranks |= {bytes([ord(p), b]): len(ranks) + i for i, b in enumerate(range(128, 256))}
            asked = tiktoken.Encoding("classes", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            self._likes = {}
            for c in range(0x80, 0x110000):
                if unicodedata.category(chr(c)) == "Cn":
                    text = chr(c)
                    self._likes[c] = next((p for p in probes if len(asked.encode_ordinary(p + text)) <= len(text.encode())), " ")
        return self._likes

    def _odd(self, text: str) -> bool:
        """Whether Python's tables lack a character of `text`."""
        new = {c for c in set(text) - self.known if unicodedata.category(c) != "Cn"}
        self.known |= new
        return not self.known.issuperset(text)

    def pieces(self, text: str) -> list[str]:
        if self.ascii is not None and text.isascii():
            return self.ascii.findall(text)
        if not self.known.issuperset(text) and self._odd(text):
            return [text[m.start() : m.end()] for m in self.any.finditer(text.translate(self.likes()))]
        return self.any.findall(text)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {w: [] for w in WIDTHS}
        for i, piece in enumerate(pieces):
            if (whole := self.rank.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONGEST_ROW:
                out[i] = self._long(piece).astype("<u4").tobytes()
            elif piece:
                buckets[_BUCKET[len(piece)]].append(i)
        for width, members in buckets.items():
            for lo in range(0, len(members), step := max(1, CELLS // width)):
                part = members[lo : lo + step]
                self._bucket([pieces[i] for i in part], width, part, out)
        return out

    def _bucket(self, pieces: list[bytes], width: int, places: list[int], out: list[bytes]) -> None:
        rows = np.array(places)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < np.array([len(p) for p in pieces])[:, None], self.bytes[raw], np.int32(-1))
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                live = best < NONE
            else:
                live = np.zeros(len(rows), bool)
            for row, of in zip(ids[~live].astype("<i4", copy=False), rows[~live].tolist()):
                out[of] = row[row >= 0].tobytes()
            rows, ids, ranks = rows[live], ids[live], ranks[live]
            if not len(rows):
                return
            at, best, n, w = at[live], best[live], np.arange(live.sum()), ids.shape[1]
            ids[n, at] = best
            keep = np.ones(ids.shape, bool)
            keep[n, at + 1] = False
            ids = ids[keep].reshape(-1, w - 1)
            keep = np.ones(ranks.shape, bool)
            keep[n, at] = False
            ranks = ranks[keep].reshape(-1, w - 2)
            for shift in (-1, 0):  # the pairs on both sides of the new token
                has = (at + shift >= 0) & (at + shift < w - 2)
                r, c = n[has], at[has] + shift
                ranks[r, c] = self.pairs.ranks(ids[r, c], ids[r, c + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.bytes[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        pad = np.array([-1], dtype=np.int32)
        while len(ranks) and (best := ranks.min()) < NONE:
            at = np.flatnonzero(ranks == best)
            begins = np.concatenate([[True], np.diff(at) > 1])  # of places next to each other every second one is merged
            order = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[order % 2 == 0]
            around = np.concatenate([pad, ids, pad])
            new = np.full(len(at), best)
            before = np.where(np.concatenate([[False], np.diff(at) == 2]), best, around[at])
            lower = (self.pairs.ranks(before, new) < best) | (self.pairs.ranks(new, around[at + 3]) < best)
            if lower.any():
                at = at[: lower.argmax() + 1]
            ids[at] = best
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            at = at - np.arange(len(at))
            near = np.concatenate([at - 1, at])
            near = near[(near >= 0) & (near < len(ranks))]
            ranks[near] = self.pairs.ranks(ids[near], ids[near + 1])
        return ids

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; pieces new to this worker are merged together."""
        cut = [self.pieces(t) if t else [] for t in texts]
        wanted = set().union(*cut)
        new = [p for p in wanted if p not in self.memo]
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
            new = list(wanted)
        self.memo.update(zip(new, self.merged([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
        for pieces in cut:
            yield b"".join(map(self.memo.__getitem__, pieces))
        for p in new:
            if len(p) > MEMO_KEY:
                del self.memo[p]
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """One vocabulary per worker process, its memo kept from task to task."""
    return ByteBpe(path, pattern)


def _slices(texts: list[str | None]) -> Iterator[slice]:
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > SLICE:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text or "")
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """Adds to the columns of `docs` the columns ids (array of int) and decoded (binary, the bytes of the text)."""
    from pyspark.sql import types as T

    path, pattern = path or default_ranks(), pattern or default_pattern()
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    at = [f.name for f in kept].index(text)

    def run(batches):
        import pyarrow as pa

        claim("byte_bpe")
        bpe = load(path, pattern)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for part in _slices(texts):
                rows = batch.slice(part.start, part.stop - part.start)
                ids = [np.frombuffer(i, dtype="<i4") for i in bpe.encode_all(texts[part])]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype("<i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                decoded = pa.array([bpe.decode(i.tolist()) for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, decoded], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def report(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs` (doc_id, text).

    The digests are taken beside the encoder, so that ids and decoded texts need not leave the worker.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def rows(columns):
        claim("byte_bpe")
        bpe = load(path, pattern)
        doc_ids, texts = columns
        for part in _slices(texts):
            out = {"doc_id": doc_ids[part], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for coded in bpe.encode_all(texts[part]):
                ids = np.frombuffer(coded, dtype="<u4").tolist()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield out

    return arrow_map(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
