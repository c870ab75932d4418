"""Sitemaps record by record: chunks, faults, limits, memory, the data source, expansion."""

import gzip
import random
import tracemalloc
from xml.etree import ElementTree

import pytest

from gossamer.sources import sitemap_records as sr
from gossamer.sources import sitemaps

SPACE = f'xmlns="{sitemaps.NAMESPACE}"'


def cut_up(data: bytes, size: int):
    return [data[i : i + size] for i in range(0, len(data), size)]


def whole(data: bytes):
    """The same by reading the whole tree."""
    ns = "{" + sitemaps.NAMESPACE + "}"
    root = ElementTree.fromstring(data)
    kind = root.tag.removeprefix(ns)
    for i, item in enumerate(root.iter(ns + {"urlset": "url", "sitemapindex": "sitemap"}[kind])):
        fields = [item.find(ns + f) for f in sr.FIELDS]
        yield kind, i, *["".join(f.itertext()).strip() if f is not None else None for f in fields], None


def test_equal_to_reading_the_whole_tree_at_every_chunk_size():
    rng = random.Random(5)
    for _ in range(150):
        kind, item = rng.choice((("urlset", "url"), ("sitemapindex", "sitemap")))
        parts = []
        for _ in range(rng.randrange(6)):
            fields = [f"<{f}>{rng.choice(('a&amp;b', ' http://ä/ ', '<!-- c -->x', '<![CDATA[<y>]]>', 'u<b>v</b>w', ''))}</{f}>" for f in rng.choices((*sr.FIELDS, "other", "x:loc"), k=rng.randrange(6))]
            parts.append(f"<{item}>{''.join(fields)}</{item}>" + rng.choice(("", "\n", "<!-- -->", "<other><deep/></other>", "<x:url><loc>no</loc></x:url>")))
        data = f'<?xml version="1.0" encoding="UTF-8"?>\n<!-- c --><{kind} {SPACE} xmlns:x="urn:x">{"".join(parts)}</{kind}>'.encode()
        want = list(whole(data))
        for size in (1, 7, 64, 1 << 20):
            assert list(sr.xml_records(cut_up(data, size))) == want


def test_items_come_before_the_fault():
    good = "<url><loc>http://a/{}</loc></url>"
    for tail in ("<url><loc>x</loc>", "<url></loc></url>", "</urlset>junk", "<url><loc>&unknown;</loc></url>"):
        rows = list(sr.xml_records(cut_up(f"<urlset {SPACE}>{good.format(0)}{good.format(1)}{tail}".encode(), 5)))
        assert [r[2] for r in rows] == ["http://a/0", "http://a/1", None] and rows[-1][1] == 2 and rows[-1][-1] == sr.INVALID
    faults = {"": sr.INVALID, "no markup": sr.INVALID, "<urlset/>": sr.NO_ROOT, f"<other {SPACE}/>": sr.NO_ROOT, f'<!DOCTYPE urlset [<!ENTITY a "b">]><urlset {SPACE}/>': sr.INVALID}
    for text, fault in faults.items():
        assert [r[-1] for r in sr.xml_records([text.encode()])] == [fault]
    assert list(sr.xml_records([f"<urlset {SPACE}/>".encode()])) == []


def test_text_lines_and_limits():
    data = "﻿http://a/1\r\n\r\n http://ä/2 \rhttp://a/3\n\nhttp://a/4".encode()
    want = [(0, "http://a/1"), (2, "http://ä/2"), (3, "http://a/3"), (5, "http://a/4")]
    for size in (1, 2, 3, 1000):
        assert [(r[1], r[2]) for r in sr.text_records(cut_up(data, size))] == want
        over = list(sr.text_records(cut_up(data, size), max_lines=2))
        assert [r[2] for r in over] == ["http://a/1", "http://ä/2", None] and over[-1][-1] == sr.TOO_LARGE
        assert [r[-1] for r in sr.text_records(cut_up(data, size), max_lines=4, max_bytes=len(data))] == [None] * 4
        small = list(sr.text_records(cut_up(data, size), max_bytes=len(data) - 1))
        assert [(r[1], r[2], r[-1]) for r in small] == [(0, "http://a/1", None), (2, "http://ä/2", None), (3, "http://a/3", None), (5, None, sr.TOO_LARGE)]
    assert list(sr.text_records([])) == []


def test_a_file_of_fifty_megabytes_is_read_in_bounded_memory():
    item = "<url><loc>http://a/{}</loc><lastmod>2023-01-01</lastmod></url>" + " " * 200
    n = 200_000

    def chunks():
        yield f"<urlset {SPACE}>".encode()
        for i in range(0, n, 1000):
            yield "".join(item.format(k) for k in range(i, i + 1000)).encode()
        yield b"</urlset>"

    tracemalloc.start()
    try:
        assert sum(r[-1] is None for r in sr.xml_records(chunks())) == n
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()


def test_data_source_reads_folders_of_files(spark, tmp_path):
    folder = tmp_path / "maps"
    (folder / "more").mkdir(parents=True)
    urlset = f"<urlset {SPACE}>" + "".join(f"<url><loc>/{i}</loc><priority> 0.5 </priority></url>" for i in range(5000)) + "</urlset>"
    (folder / "a.xml").write_text(urlset)
    (folder / "more" / "b.xml.gz").write_bytes(gzip.compress(urlset.replace("</urlset>", "").encode()))
    (folder / "c.xml").write_bytes(f'<?xml version="1.0" encoding="iso-8859-1"?><sitemapindex {SPACE}><sitemap><loc>/ä</loc></sitemap></sitemapindex>'.encode("latin-1"))
    (folder / "d.txt").write_text("http://a/1\nhttp://a/2\nhttp://a/3")
    (folder / "_SUCCESS").write_text("")
    sr.register(spark)
    rows = spark.read.format("sitemap_files").option("max_lines", 2).option("chunk_bytes", 1000).option("partition_bytes", 50_000).load(str(folder))
    assert rows.rdd.getNumPartitions() > 1
    got = {}
    for r in rows.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.kind, r.item, r["loc"], r.priority, r.fault))
    want = [("urlset", i, f"/{i}", "0.5", None) for i in range(5000)]
    assert got["a.xml"] == want and got["b.xml.gz"] == [*want, ("urlset", 5000, None, None, sr.INVALID)]
    assert got["c.xml"] == [("sitemapindex", 0, "/ä", None, None)]
    assert [r[2] for r in got["d.txt"]] == ["http://a/1", "http://a/2", None] and len(got) == 4
    (tmp_path / "none").mkdir()
    assert spark.read.format("sitemap_files").load(str(tmp_path / "none")).count() == 0


def test_records_of_rows(spark):
    rows = [("x", "application/xml", f"<urlset {SPACE}><url><loc>/1</loc></url><url><lastmod>no</lastmod></url></urlset>"), ("t", "text/plain", "http://a"), ("n", None, None), ("n", "text/plain", None)]
    got = {tuple(r) for r in sr.records(spark.createDataFrame(rows, "site string, content_type string, body string")).collect()}
    assert got == {("x", "urlset", 0, "/1", None, None, None, None), ("x", "urlset", 1, None, "no", None, None, None), ("t", "text", 0, "http://a", None, None, None, None), ("n", None, 0, None, None, None, None, sr.INVALID)}


def test_expansion_takes_what_comes_before_a_fault_or_ends_there(spark):
    files = spark.createDataFrame([("m", "text/xml", f"<urlset {SPACE}><url><loc>/1</loc></url><url>"), ("o", "text/xml", f"<urlset {SPACE}><url><lastmod>2023-01-01</lastmod></url><url><loc>/2</loc></url></urlset>")], "loc string, content_type string, body string")
    for name, item, fault in (("m", "/1", sr.INVALID), ("o", "/2", "invalid location")):
        start = spark.createDataFrame([("s", name)], "site string, loc string")
        assert [r["loc"] for r in sitemaps.expand(start, files).collect()] == [item]
        with pytest.raises(sitemaps.SitemapError, match=fault):
            sitemaps.expand(start, files, abort=True)


def test_registered_queries_match_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    from gossamer.plans.catalog import ORACLE, QUERIES

    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    for name in ("sitemap_records", "sitemap_records_broken", "sitemap_records_limit", "sitemap_expand"):
        frame, cursor = QUERIES[name](spark, folder), db.execute(ORACLE[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall())), name
