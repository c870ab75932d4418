"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest

from gossamer.llm import byte_bpe

PATH, PATTERN = byte_bpe.default_ranks(), byte_bpe.default_pattern()


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(library, texts: list[str]) -> None:
    bpe = byte_bpe.load(PATH, PATTERN)
    for part in byte_bpe._slices(texts):
        for text, coded in zip(texts[part], bpe.encode_all(texts[part]), strict=True):
            ids = np.frombuffer(coded, dtype="<u4").tolist()
            assert ids == library.encode_ordinary(text), repr(text)[:200]
            assert bpe.decode(ids) == text.encode()


def test_random_texts_in_many_scripts(library):
    rng = random.Random(1)
    letters = "aeinst  '!?.,0159\n\t\r \u0085 éüßÄçñ中文字日本かなカナ한국어абвгд́ͅ😀\U0001f3fdا٣²½\x1c\x1f\x00"
    same(library, ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(5000)])


def test_every_code_point_next_to_letters_digits_and_signs(library):
    around = ["a{0}b 1{0}2 {0}!{0} ".format(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(library, ["".join(around[i : i + 256]) for i in range(0, len(around), 256)])


def test_long_pieces_merge_like_short_ones(library):
    rng = random.Random(2)
    tokens = [t.decode("utf-8", "ignore").strip() for t in rng.sample(list(byte_bpe.load(PATH, PATTERN).rank), 3000)]
    runs = ["".join(rng.choices("abcdefghij"[: rng.randint(1, 10)], k=rng.randint(250, 2000))) for _ in range(20)]
    same(library, ["".join(rng.choices(tokens, k=200)) for _ in range(20)] + runs + ["a" * 20000, " " * 5000, "ab" * 4000 + " x"])


def test_long_pieces_stop_before_a_pair_of_lower_rank():
    """With ranks that no training gives: merging b and c first makes a pair that goes before the other places."""
    bpe = byte_bpe.load(PATH, PATTERN)
    own = object.__new__(byte_bpe.ByteBpe)
    own.__dict__ |= bpe.__dict__
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"abc": 2, b"bc": 300, b"abcb": 1, b"cb": 301}
    halves = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    own.rank, own.bytes, own.pairs = ranks, np.arange(10, 266, dtype=np.int32), byte_bpe.PairTable(*np.array(halves).T)

    def plain(piece: bytes) -> list[int]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    for _ in range(300):
        piece = bytes(rng.choices(b"abc", k=rng.randint(2, 40)))
        if piece not in ranks:
            assert own._long(piece).tolist() == plain(piece) == np.frombuffer(own.merged([piece])[0], dtype="<u4").tolist(), piece


def test_report_on_odd_tables(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello world, it's 42!"), (3, "Hello world, it's 42!"), (None, "x" * 3000), (5, "word " * 20000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, ids int, rank string")
    got = sorted(map(tuple, byte_bpe.report(docs).collect()), key=str)
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = byte_bpe.encode_documents(docs)
    assert full.columns == ["doc_id", "text", "rank", "ids", "decoded"]
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.ids == library.encode_ordinary(r.text or "") for r in full.collect())
    assert byte_bpe.report(docs.limit(0)).collect() == []
