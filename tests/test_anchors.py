"""Anchors of broken pages against a tokenizer that goes from letter to letter."""

import random
import time
from html.entities import html5

from pyspark.sql import functions as F

from gossamer.operators import links

SPACE = "\t\n\f\r "
RAW = set(links.RAW.split("|"))
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def unescaped(text):
    out, i = [], 0
    while i < len(text):
        if text[i] != "&":
            out.append(text[i])
            i += 1
            continue
        j = i + 1
        if text[j : j + 1] == "#":
            base, k = (16, j + 2) if text[j + 1 : j + 2] in ("x", "X") else (10, j + 1)
            end = k
            while end < len(text) and text[end] in ("0123456789abcdefABCDEF" if base == 16 else "0123456789"):
                end += 1
            if end > k:
                n = int(text[k:end], base)
                if 0x80 <= n <= 0x9F:
                    char = bytes([n]).decode("cp1252", "ignore") or chr(n)
                else:
                    char = "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)
                out.append(char)
                i = end + (text[end : end + 1] == ";")
                continue
        end = j
        while end < len(text) and text[end].isascii() and text[end].isalnum():
            end += 1
        name, after = text[j:end], text[end : end + 1]
        if after == ";" and name + ";" in html5:
            out.append(html5[name + ";"])
            i = end + 1
        elif name in html5 and after not in (";", "="):
            out.append(html5[name])
            i = end
        else:
            out.append("&")
            i += 1
    return "".join(out)


def tag_at(s, i):
    """(end, attributes) of the tag whose name begins at i, or None if it is not closed."""
    n, attrs = len(s), {}
    while i < n and s[i] not in SPACE + "/>":
        i += 1
    while i < n:
        if s[i] in SPACE + "/":
            i += 1
        elif s[i] == ">":
            return i + 1, attrs
        else:
            k = i
            i += 1
            while i < n and s[i] not in SPACE + "/>=":
                i += 1
            name, value, m = s[k:i].lower(), "", i
            while m < n and s[m] in SPACE:
                m += 1
            if s[m : m + 1] == "=":
                m += 1
                while m < n and s[m] in SPACE:
                    m += 1
                if s[m : m + 1] in ("'", '"'):
                    end = s.find(s[m], m + 1)
                    if end < 0:
                        return None
                    value, i = s[m + 1 : end], end + 1
                else:
                    i = m
                    while i < n and s[i] not in SPACE + ">":
                        i += 1
                    value = s[m:i]
            attrs.setdefault(name, value)
    return None


def plain(s):
    out, i, n = [], 0, len(s)
    while (i := s.find("<", i)) >= 0:
        after = s[i + 1 : i + 2]
        if s.startswith("<!--", i):
            if s.startswith(">", i + 4) or s.startswith("->", i + 4):
                i = s.index(">", i) + 1
                continue
            ends = [(k, m) for m in ("-->", "--!>") if (k := s.find(m, i + 4)) >= 0]
            if not ends:
                break
            i = min(ends)[0] + len(min(ends)[1])
        elif after and after in LETTERS or after == "/" and s[i + 2 : i + 3] and s[i + 2 : i + 3] in LETTERS:
            begin = i + 1 + (after == "/")
            found = tag_at(s, begin)
            if not found:
                break
            name = begin
            while s[name] not in SPACE + "/>":
                name += 1
            name = s[begin:name].lower()
            i, attrs = found
            if after != "/" and name == "a" and "href" in attrs:
                out.append(unescaped(attrs["href"]))
            if after != "/" and name in RAW:
                while True:
                    k = s.lower().find("</" + name, i)
                    if k < 0:
                        return out
                    i = k + 2
                    if s[i + len(name) : i + len(name) + 1] in tuple(SPACE + "/>") and (closed := tag_at(s, i)):
                        i = closed[0]
                        break
        elif after in ("!", "?", "/") and i + 2 <= n and not (after == "/" and i + 2 == n):
            k = s.find(">", i + 2)
            if k < 0:
                break
            i = k + 1
        else:
            i += 1
    return out


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, html string").select("i", links.hrefs(F.col("html")).alias("h"))
    return [r.h for r in rows.orderBy("i").collect()]


def test_random_soups(spark):
    rng = random.Random(1)
    parts = ["<", ">", "/", "=", '"', "'", " ", "\n", "-", "!", "a", "<a ", "<a href=", "href", " href = ", "<A HREF='", "x", "&amp;", "&lt", "&copy", "&#65", "&#x80;", "&notit;", "<!--", "-->", "--!>", "<!", "<?", "<![", "]]>", "</", "</a>", "<script>", "</script>", "</script", "<style ", "<title>", "</title>", "<b c=d>", "é", "<br/>", "<abbr href=q>", "&NotEqualTilde;", "&ampx="]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(10_000)]
    texts += ["", "<", "</", "<!", "<!-->x<a href=1>", "<!--->x<a href=2>", "<a/href=3>", "<a href>", "<a href=''>", "<a href= >x", "<a =x href=4 href=5>", "<a href=6/>", "<a href='7'x>", "<script><a href=8></scripty></script ><a href=9>", "<p>one <![foo]> two<a href=10>", "see a[0]<![b"]
    got = found(spark, texts)
    wrong = [(t, g, plain(t)) for t, g in zip(texts, got, strict=True) if g != plain(t)]
    assert not wrong, wrong[:3]
    assert sum(map(len, got)) > 1000


def test_every_named_reference(spark):
    names = sorted(html5)
    texts = [f"<a href=\"x&{n}y\"><a href='&{n}'>" for n in names]
    assert found(spark, texts) == [[unescaped(f"x&{n}y"), unescaped(f"&{n}")] for n in names]


def test_work_follows_the_length(spark):
    found(spark, ["<a href=x>"])
    for unit in ("<!--", "<a b='", "<script>", "<a <b ", "<a href='x'>y</a>", '<b c="d" ', "<![", "&amp;", "<a href='&", "--", "<!-- -- "):
        text = unit * (2_000_000 // len(unit))
        began = time.time()
        assert found(spark, [text])[0] is not None
        assert time.time() - began < 20, unit
