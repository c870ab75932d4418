"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a text may be
cut there before encoding.  Every fragment between two cuts is encoded on its own, the results are
concatenated, and equal fragments are encoded once per worker.

Texts with characters that Python's Unicode tables do not know, or with combining marks that they order otherwise
than those of the tokenizers library, are put into words by the library; the words are then encoded like all others.

Defined results: a null or empty text has no ids and decodes to the empty string; very long words are
encoded with a heap in n log n steps; repeated rows are encoded alike; an empty table has no rows; columns of
the table named ids or decoded are replaced, all others are kept as they are.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache
from operator import add

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import Memo, arrow_map, claim

#: Longer results are not kept.
MEMO_BYTES = 128
#: Fragments above this many symbols are merged with a heap.
LONG_FRAGMENT = 48
#: str.split() takes these for white space, the vocabulary's pattern does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"\p{White_Space}+")


@lru_cache(maxsize=1)
def reordered() -> frozenset[str]:
    """Combining marks that Python's tables order otherwise than the library's, which are older: beside a mark of the
    lowest and of a high class the two normalize them differently."""
    from tokenizers.normalizers import NFC

    library, marks = NFC(), [c for c in map(chr, range(0x300, 0x110000)) if unicodedata.combining(c)]
    beside = [("a", "\u0334"), ("a\u0301", ""), ("a\u0345", ""), ("a\u0334", "")]
    return frozenset(c for c in marks if any(library.normalize_str(a + c + b) != unicodedata.normalize("NFC", a + c + b) for a, b in beside))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class _Short(Memo):
    """A memo of byte strings that keeps short ones only (ids of a long text are as many bytes at least)."""

    def keep(self, value: bytes) -> bool:
        return len(value) <= MEMO_BYTES


class Bpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.library, self.known = path, None, set()
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in (self.ids | self.special).items()}
        self.tokens = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.letters = byte_letters()
        self.joined = self._joined_pairs()
        self.fragments = _Short(self._encode_fragment)
        self.chunks = _Short(self._encode_chunk)
        alternatives = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.special_split = regex.compile(f"({alternatives})") if self.special else None

    def _joined_pairs(self) -> set[str]:
        """All pairs of neighbouring byte letters inside vocabulary tokens."""
        inner = (t.removesuffix(self.end) for t in self.ids)
        return {t[i : i + 2] for t in inner for i in range(len(t) - 1)}

    def cuts(self, word: str) -> list[str]:
        """`word`, in byte letters, cut at every pair that no token holds."""
        joined = self.joined
        at = [i + 1 for i, pair in enumerate(map(add, word, word[1:])) if pair not in joined]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)])] if at else [word]

    def _encode_fragment(self, key: tuple[str, bool]) -> bytes:
        letters, last = key
        symbols = list(letters)
        if last:
            symbols[-1] += self.end
        if len(symbols) > LONG_FRAGMENT:
            symbols = self._merge_long(symbols)
        elif len(symbols) > 1:
            symbols = self._merge_short(symbols)
        return np.array([self.ids[s] for s in symbols], dtype="<u4").tobytes()

    def _merge_short(self, symbols: list[str]) -> list[str]:
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:])]
        while (best := min(ranks)) < none:
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if not ranks:
                break
            if at:
                ranks[at - 1] = rank((symbols[at - 1], symbols[at]), none)
            if at < len(ranks):
                ranks[at] = rank((symbols[at], symbols[at + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        n = len(symbols)
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (r := self.ranks.get((symbols[i], symbols[j]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if live[i] else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], live[j], right[i] = a + b, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i], i)
            push(i, right[i])
        return [s for s, alive in zip(symbols, live, strict=True) if alive]

    def _library_words(self, text: str) -> list[str]:
        """The words of `text`, in byte letters, by the library's Unicode tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(text)
        return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _encode_words(self, words: list[str]) -> bytes:
        """The ids of `words` in byte letters."""
        out = []
        for word in words:
            parts = self.cuts(word)
            out += [self.fragments[p, False] for p in parts[:-1]]
            out.append(self.fragments[parts[-1], True])
        return b"".join(out)

    def _odd(self, text: str) -> bool:
        """Whether Python's tables lack a character of `text`, or order it otherwise than the library's."""
        self.known |= {c for c in set(text) - self.known if unicodedata.category(c) != "Cn" and c not in reordered()}
        return not self.known.issuperset(text)

    def _encode_plain(self, text: str) -> bytes:
        plain = text.isascii() and text.isprintable()
        if not plain and not self.known.issuperset(text) and self._odd(text):
            return self._encode_words(self._library_words(text))
        text = text.lower() if plain else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words, letters = self.words.findall(text), self.letters
        return self._encode_words(words if plain else ["".join([letters[b] for b in word.encode("utf-8", "surrogatepass")]) for word in words])

    def _encode_chunk(self, chunk: str) -> bytes:
        if self.special_split is None or "<" not in chunk:
            return self._encode_plain(chunk)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._encode_plain(p) for p in self.special_split.split(chunk) if p)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        chunks = _SPACE.split(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One vocabulary per worker process, its memos kept from task to task."""
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Adds to the columns of `docs` the columns ids (array of int) and decoded (string)."""
    path = path or default_tokenizer()
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    at = [f.name for f in kept].index(text)

    def run(batches):
        import pyarrow as pa

        claim("bpe")
        bpe = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [bpe.encode(t) for t in part.column(at).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype("<i4")
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                decoded = pa.array([bpe.decode(i) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, decoded], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs` (doc_id, text).

    The digests are taken beside the encoder, so that ids and decoded texts need not leave the worker.
    """
    path = path or default_tokenizer()

    def rows(columns):
        claim("bpe")
        bpe = load(path)
        ids, texts = columns
        coded = [bpe.encode(t) for t in texts]
        yield {
            "doc_id": ids,
            "n_tokens": [len(c) // 4 for c in coded],
            "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
            "decoded_sha256": [hashlib.sha256(bpe.decode(c).encode("utf-8", "surrogatepass")).hexdigest() for c in coded],
        }

    return arrow_map(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
