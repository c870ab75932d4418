"""BPE, token files, decontamination, personal data, page text and toxicity on small hand-made rows."""

import hashlib
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest
from pyarrow import fs

from gossamer.llm import bpe, decontaminate, html_text, pii, tokenfile, toxicity
from gossamer.llm.common import shared_dir

ODD_TEXTS = [None, "", " ", "a", "Hello  WORLD's don't 123 naïve ＡＢ é <|endoftext|> foo_bar İstanbul ß ΣΑΣ", "a\x1cb \x1f", "x" * 5000 + "the" * 300, "日本語😀 't've", "!!!???", "q\x85z r\xa0s", "thing " * 4000]
DOCS = "doc_id long, text string"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_bpe_equals_the_library(spark, tokenizer):
    rows = {r.doc_id: r for r in bpe.encode_digests(frame(spark, ODD_TEXTS)).collect()}
    for i, text in enumerate(ODD_TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_cuts_where_no_token_joins(tokenizer):
    coder = bpe.load(bpe.default_tokenizer())
    for word in ("thereupon", "xqzjvkw" * 20, "zzzzqqqq"):
        parts = coder.cuts(word)
        assert "".join(parts) == word
        assert all(a[-1] + b[0] not in coder.joined for a, b in zip(parts, parts[1:]))
        assert np.frombuffer(coder.encode(word), "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids


def test_bpe_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "own", 3)], "doc_id long, text string, ids string, extra int")
    row = bpe.encode_documents(docs).first()
    assert row.extra == 3 and row.decoded == "a</w> b</w>" and len(row.ids) == 2
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_token_file_round_trip(spark, tokenizer):
    docs = spark.createDataFrame([*[(i, t) for i, t in enumerate(ODD_TEXTS)], (3, "again"), (None, "no id")], DOCS)
    rows = sorted(tokenfile.report(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows][:2] == [None, 0] and len(rows) == len(ODD_TEXTS) + 2
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    for i in (0, 4, 6, 10):
        ids = tokenizer.encode(ODD_TEXTS[i] or "", add_special_tokens=False).ids + [tokenfile.END_ID]
        (row,) = [r for r in rows if r.doc_id == i]
        assert row.n_tokens == len(ids) and row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert tokenfile.report(docs.limit(0)).count() == 0


def test_token_file_deals_text_by_size_and_equal_rows_over_shards(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 2000)
    docs = spark.createDataFrame([(7, "the same row again and again")] * 900 + [(i, f"row {i} " + "x" * i) for i in range(300)], DOCS)
    manifest = tokenfile.write(docs, f"file://{tmp_path}/shards")
    assert manifest.where("documents > 0").count() > 10 and manifest.agg({"documents": "max"}).first()[0] < 600
    rows = sorted(tokenfile.read(manifest, f"file://{tmp_path}/shards").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len(rows) == 1200
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_token_file_reads_single_documents_and_notices_damage(spark, tmp_path):
    path = tmp_path / "one.ztk"
    ids = {d: np.arange(d, d + 30_000, dtype="<u4").tobytes() for d in range(12)}
    with open(path, "wb") as f:
        writer = tokenfile.ShardWriter(f)
        for d, i in ids.items():
            writer.add(d, i)
        writer.close()
    store = fs.LocalFileSystem()
    with store.open_input_file(str(path)) as source:
        reader = tokenfile.ShardReader(source)
        assert len(reader.table) == 4
        assert dict(reader.documents({5, 11})) == {5: ids[5], 11: ids[11]}
    raw = bytearray(path.read_bytes())
    raw[200] ^= 1
    path.write_bytes(raw)
    with store.open_input_file(str(path)) as source, pytest.raises(Exception):
        tokenfile.ShardReader(source).frame(0)


def brute_hits(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hits, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hits.update(range(j, j + size))
                    found.add(str(item))
    return len(words), len(hits), sorted(found)


@pytest.mark.parametrize("most", [200_000, 7])
def test_decontamination_against_brute_force(spark, most):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Short one"), (3, ""), (4, None), (10, "é è ê"), (5, " ".join(f"w{i}" for i in range(5, 20)))]
    texts = [None, "", long.upper() + "!", "x " + " ".join(f"w{i}" for i in range(3, 16)) + " y short ONE. é-è-ê", " ".join(f"w{i}" for i in range(9)), "short short one one short one"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find(frame(spark, texts), bench, max_rows=most).collect()}
    for i, t in enumerate(texts):
        words, hits, own = brute_hits(t, items)
        assert (found[i]._words, len(found[i]._hits), found[i]._items) == (words, hits, own)
    clean = {r.doc_id: r.text for r in decontaminate.remove_spans(frame(spark, texts), bench, most=0.9, max_rows=most).collect()}
    assert 2 not in clean and clean[3] == "x  y " and clean[4] == texts[4] and clean[0] is None
    assert decontaminate.report(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(frame(spark, texts).limit(0), bench).count() == 0
    # columns with the operator's own names, repeated rows
    named = frame(spark, texts).selectExpr("doc_id", "text", "'mine' AS _hits", "1 AS _words", "2 AS _at", "3 AS key")
    kept = decontaminate.remove_spans(named.union(named), bench, most=0.9, max_rows=most)
    assert kept.columns == named.columns and kept.where("_hits = 'mine' AND _words = 1 AND _at = 2 AND key = 3").count() == 2 * len(clean)


def test_decontamination_by_join_equals_by_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    one, other = (decontaminate.find(docs, bench, max_rows=m).select("doc_id", "_hits", "_items", "_words") for m in (1 << 20, 10))
    assert one.where("size(_hits) > 0").count() > 0
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def test_personal_data(spark):
    texts = [None, "", "mail a.b@c.de or a@b@c.org%x@y.zz 1.2.3.4.5.6.7.8 999.1.1.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112; +1 (415) 555-2671 +1 2", "call (415) 555-2671 now", "9" * 40_000 + " " + "a" * 40_000 + "é 10.0.0.1", "write to bob [at] site [dot] com please"]
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0
        return {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]

    rows = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if good(kind, m[0]))
        want = [f"{kind}:{a}:{b}" for a, _, b, kind in spans]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(rows[i].spans.split(",")) | ({""} if not want else set())
    assert pii.report(frame(spark, texts).limit(0)).count() == 0


def test_span_classifier_learns_reliable_votes():
    yes, no = sum(2 * 3**k for k in range(pii.VOTES)), 0
    fitted = pii.fit([(3, 1, yes, 1, 50), (3, 1, no, 1, 50), (3, 0, yes, 1, 50)])["weights"]
    assert all(w > 0 for w in fitted[7 : 7 + pii.VOTES])
    assert pii.fit([])["weights"]


def test_added_spans_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    added = {r.doc_id: [(a.kind, texts[r.doc_id][a.start : a.end]) for a in r.added] for r in pii.find(docs).collect()}
    tokens = {d: [m[1] for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)] for d, t in texts.items()}
    assert sum(map(len, tokens.values())) > 50
    assert {d: [v for k, v in found if k == "secret"] for d, found in added.items()} == tokens
    others = [x for found in added.values() for x in found if x[0] != "secret"]
    assert not [x for x in others if x[0] == "card"], others[:5]


def test_added_spans_by_form_and_clashing_columns(spark):
    said = [
        "write to jane.roe (at) example (dot) com today",
        "call 0049 30 1234567 or phone (212) 555-0199 now",
        "host at 2001:0db8:85a3:0000:0000:8a2e:0370:7334 today",
        'api_key: "sk9f8e7d6c5b4a3928171605" and x=aaaaaaaaaaaaaaaa',
        "commit 4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e; version: 2.10.33.4000; order 1234567890123456",
    ]
    rows = [(i, t, "b", 7, 8) for i, t in enumerate(said * 20)] + [(500, None, "b", 7, 8), (501, "", "b", 7, 8), (502, "1 " * 50_000 + "+" * 50_000 + "a" * 100_000, "b", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, _id int, judged int")
    got = pii.find(docs).collect()
    assert len(got) == len(rows) and set(pii.find(docs).columns) == {"doc_id", "text", "base", "_id", "judged", "added"} and got[0]["_id"] == 7 and got[0].judged == 8
    texts = {r.doc_id: [(a.kind, r.text[a.start : a.end]) for a in r.added] for r in got}
    assert texts[0] == [("email", "jane.roe (at) example (dot) com")] and texts[2] == [("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]
    assert ("phone", "0049 30 1234567") in texts[1] and texts[3] == [("secret", "sk9f8e7d6c5b4a3928171605")] and texts[4] == []
    assert texts[500] == texts[501] == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy this</div><article><h1>Head &amp; more</h1>
<p><b>First   paragraph,<br>with &quot;quotes&quot; and&nbsp;a <a href="/x">link</a>.<p>Second.</p><ul><li>One</li><li>Two</li></ul>
<div class="share">Share it</div><form><input><p>Name</p></form><p>Third, at some length, so that it counts as text.</p>
<section class="comments"><p>Reader says no.</p></section></article><aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_page_text(spark):
    want = 'Head & more\nFirst paragraph, with "quotes" and a link.\nSecond.\nOne\nTwo\nThird, at some length, so that it counts as text.'
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", PAGE[: PAGE.index("Second") + 3]), (5, "u", "<p>no tags around this text at all, just a line"), (6, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert rows[1].text == want and rows[1].n_chars == len(want)
    assert rows[2].text == "" and rows[3].text == "" and rows[2].n_chars == 0
    assert rows[4].text == 'Head & more\nFirst paragraph, with "quotes" and a link.\nSec'
    assert rows[5].text == "no tags around this text at all, just a line" and rows[6].text == "deep"


def test_page_text_without_article_takes_the_dense_region():
    menu = "".join(f'<div><a href="/{i}">m{i}</a></div>' for i in range(12))
    body = "".join(f"<p>{'content words go on and on ' * 6}{i}</p>" for i in range(6))
    text = html_text.main_text(f"<body><div id='left'>{menu}</div><div id='mid'>{body}</div></body>")
    assert text.count("\n") == 5 and "m3" not in text
    assert html_text.threshold([1.0, 1.1, 9.0, 9.1]) == pytest.approx(5.05)


@pytest.mark.parametrize("name", ["content has-sidebar", "with-sidebar", "no-sidebar", "post-header", "page_header", "content with-sidebar", "container no-sidebar", "has-header main-content", "layout-menu-left", "ad-free", "share-price-report", "story related-to-art"])
def test_page_text_inside_a_wrapper_that_is_named_like_noise(name):
    body = [f"{'content words go on and on ' * 6}{i}" for i in range(6)]
    menu = "".join(f'<li><a href="/{i}">m{i}</a></li>' for i in range(5))
    page = f"<body><div class='main-menu'><ul>{menu}</ul></div><div class='{name}'>{''.join(f'<p>{b}</p>' for b in body)}<div class='share'>Share</div></div><div class='ad'>{'buy ' * 600}</div></body>"
    assert html_text.main_text(page) == "\n".join(body)


def test_page_text_loses_no_paragraph_for_its_name_and_no_page_for_a_form():
    body = [f"{'content words go on and on ' * 6}{i}" for i in range(6)]
    named = "".join(f"<p id='search' class='menu'>{b}</p>" if i == 2 else f"<p>{b}</p>" for i, b in enumerate(body))
    assert html_text.main_text(f"<article>{named}<div class='newsletter'>Mail us</div><form><p>Your name</p></form></article>") == "\n".join(body)
    assert html_text.main_text(f"<body><form id='all'><div>{named}</div><div class='social'><a href='/'>x</a></div></form></body>") == "\n".join(body)
    assert html_text.main_text(f"<div class='cookie-notice'>{'we use cookies ' * 40}</div><article><p>Short.</p></article>") == "Short."
    long_comment = "<p>" + "said the reader " * 90 + "</p>"
    assert html_text.main_text(f"<article>{named}<section id='comments'>{long_comment}</section></article>") == "\n".join(body)


@pytest.mark.parametrize("tag", ["div", "span", "article", "p", "b class='menu'", "section id=ad-free", "li", "x-y"])
def test_page_text_of_deep_and_unclosed_markup(tag):
    began = time.time()
    assert html_text.main_text(f"<{tag}>" * 100_000 + "deep text") == "deep text"
    assert "text" in html_text.main_text(f"<table><td>{'<x-y>' * 50_000}" + f"<{tag}>a</td></q></h2>" * 20_000 + "text")
    assert time.time() - began < 60


def by_hand(html):
    """The blocks of the article of a generated page."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", html or "", re.S)
    blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inner[1] if inner else "")
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_page_text_equals_the_article_of_every_given_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {i: by_hand(h) for i, h in html.items()} and len(got) == pages.count()
    assert html_text.extract(pages.limit(0)).count() == 0


def test_page_text_of_main_with_a_smaller_article():
    own, rest = ["".join(f"<p>{f'{w} goes on and on ' * 8}{i}</p>" for i in range(n)) for w, n in (("inner", 6), ("outer", 4))]
    text = html_text.main_text(f"<body><main><article>{own}</article><section>{rest}</section></main></body>")
    assert text.count("\n") == 9 and "outer" in text


def test_toxicity_learns_pairs(spark):
    # neither word alone is toxic, both together are
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(1600):
        a, b = rng.random(2) < 0.5
        words = [f"w{rng.integers(40)}" for _ in range(8)] + ["insultword"] * int(a) + ["groupword"] * int(b)
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(a and b)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], DOCS)
    scored = {r.doc_id: r for r in toxicity.report(docs, spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")).collect()}
    held = [i for i in range(1600) if scored[i].held_out]
    assert 300 < len(held) < 500 and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    assert np.mean([(scored[i].score >= 0.5) == labels[i][1] for i in held]) > 0.97
    assert scored[5000].score == scored[5001].score and 0 <= scored[5000].score <= 1
    none = toxicity.report(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.select("score").distinct().count() == 1


def test_toxicity_learns_pairs_of_words_that_are_neutral_alone(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(2400):
        a, b = rng.random(2) < 0.5
        words = [f"w{chr(97 + rng.integers(20))}{chr(97 + rng.integers(2))}" for _ in range(8)]
        words[3:3] = ["insultword"] * int(a) + ["groupword"] * int(b)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a == b)))
    docs = spark.createDataFrame(rows, DOCS)
    scored = {r.doc_id: r for r in toxicity.report(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i in range(2400) if scored[i].held_out]
    assert np.mean([(scored[i].score >= 0.5) == labels[i][1] for i in held]) > 0.95


def test_toxicity_on_held_out_rows_and_odd_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    held = [(r.score, truth[r.doc_id]) for r in toxicity.report(docs, labels).collect() if r.held_out and r.doc_id in truth]
    hits = sum(s >= toxicity.THRESHOLD and y for s, y in held)
    assert hits >= 0.85 * sum(y for _, y in held) and hits >= 0.9 * sum(s >= toxicity.THRESHOLD for s, _ in held)
    assert toxicity.report(docs.limit(0), labels).count() == 0
    # one id with many rows, a bound below the labels, a very long text, a column named score
    rows = [(1, f"text {i}", "x") for i in range(300)] + [(i, "bad words" if i % 3 == 0 else "good words", "x") for i in range(2, 200)] + [(500, "wordy " * 200_000 + "y" * 300_000, "x")]
    few = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.train(few, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int"), sample=100)
    got = toxicity.score(few, model)
    assert got.count() == len(rows) and dict(got.dtypes)["score"] == "double" and got.where("text = 'bad words' and score < 0.5").count() == 0


def test_shared_dir_is_below_the_setting(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_bpe_equals_the_library_for_every_character(tokenizer):
    coder = bpe.Bpe(bpe.default_tokenizer())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 1 << 16):
        texts = [f"A{chr(c)}b" for c in points[lo : lo + (1 << 16)]]
        wrong = [t for t, e in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False)) if np.frombuffer(coder.encode(t), "<u4").tolist() != e.ids]
        assert not wrong, wrong[:10]
        coder.chunks.clear()
        coder.fragments.clear()


def test_bpe_orders_combining_marks_like_the_library(tokenizer):
    """Texts of many marks, among them those whose class the library's tables lack."""
    import random
    import unicodedata

    rng, own = random.Random(5), bpe.load(bpe.default_tokenizer())
    marks = [c for c in map(chr, range(0x300, 0x110000)) if unicodedata.combining(c)]
    odd = sorted(bpe.reordered())
    assert "࣓" in odd and "́" not in odd
    texts = ["".join(rng.choice("aeouAEÅΣσ가क!1 ") + "".join(rng.choice(odd if rng.random() < 0.3 else marks) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 8))) for _ in range(30_000)]
    texts += ["a" + x + y for x in odd for y in rng.sample(marks, 60)]
    for text, found in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == found.ids, [hex(ord(c)) for c in text]


def test_pii_of_a_text_of_many_numbers(spark):
    """A megabyte of short numbers, more matches than one run holds, and long runs of digits."""
    text = "7, " * 330_000 + "call 4111 1111 1111 1111 or 10.0.0.1"
    ips = " ".join(f"10.0.{i // 256}.{i % 256}" for i in range(700))
    rows = [(1, text), (2, ips), (3, "1 " * 6 + "x" + "12345678901" + " 4111111111111111-" + "1" * 30), (4, "4111111111111111  5500005555555559 -- 41-11-11-11-11-11-11-11")]
    began = time.time()
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert time.time() - began < 90
    assert (got[1].n_card, got[1].n_ip) == (1, 1) and f"card:{len(text) - 31}:{len(text) - 12}" in got[1].spans.split(",")
    assert got[2].n_ip == 700 and [s.split(":")[1:] for s in got[2].spans.split(",") if s.startswith("ip")] == [[str(m.start()), str(m.end())] for m in re.finditer(r"\S+", ips)]
    assert got[3].n_card == 0 and got[4].n_card == 3
