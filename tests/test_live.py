"""Pages of a local server through the data source, and streams of URLs: once each, and paced."""

from __future__ import annotations

import threading
import time
from collections import Counter, defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from gossamer.operators.crawl import Options
from gossamer.operators.seen import SeenUrls
from gossamer.operators.site import crawl_site
from gossamer.sources import live, pages
from gossamer.streaming import frontier


@pytest.fixture
def server():
    asked: list[tuple[float, str]] = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.monotonic(), self.path))
            turns = sum(p == self.path for _, p in asked)
            status = 503 if self.path == "/late" and turns < 3 else 404 if self.path in ("/gone", "/robots.txt", "/sitemap.xml") else 200
            body = f"<p>{self.path}</p><a href='/a'>a</a><a href='/b'>b</a><a href='/late'>l</a><a href='/gone'>g</a>".encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def frame(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_the_source_reads_batches_with_retries_and_delays(spark, server, tmp_path):
    site, asked = server
    live.register(spark)
    folder = str(tmp_path / "urls")
    live.write_batch(frame(spark, [f"{site}/{p}" for p in ("a", "gone", "late", "b")]), folder, 0, files=3)
    live.write_batch(frame(spark, ["http://127.0.0.1:9/none", "no url"]), folder, 1, files=2)
    source = spark.read.format("web_pages").options(retries=3, backoff=0.05, delay=0.3, timeout=2)
    rows = {r.url: r for r in source.load(folder).collect()}
    assert {u.removeprefix(site): r.status for u, r in rows.items()} == {"/a": 200, "/gone": 404, "/late": 200, "/b": 200, "http://127.0.0.1:9/none": None, "no url": None}
    assert "<p>/a</p>" in rows[f"{site}/a"].body and rows["no url"].error and Counter(p for _, p in asked)["/late"] == 3
    first = sorted({p: t for t, p in reversed(asked)}.values())
    assert first[-1] - first[0] > 0.7  # three delays, measured where requests arrive


def test_the_source_streams_each_batch_once(spark, server, tmp_path):
    site, asked = server
    live.register(spark)
    folder, out, check = (str(tmp_path / n) for n in ("urls", "out", "check"))

    def run():
        stream = spark.readStream.format("web_pages").option("retries", 0).load(folder)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(r.url.removeprefix(site) for r in spark.read.parquet(out).collect())

    live.write_batch(frame(spark, [f"{site}/a"]), folder, 0)
    assert run() == ["/a"]
    live.write_batch(frame(spark, [f"{site}/b", f"{site}/gone"]), folder, 1)
    assert run() == ["/a", "/b", "/gone"] and Counter(p for _, p in asked) == {"/a": 1, "/b": 1, "/gone": 1}


def test_a_live_crawl(spark, server):
    site, _ = server
    got = crawl_site(spark, f"{site}/", lambda wanted: pages.fetch_live(wanted, parallelism=2, retries=3, timeout=5), Options())
    assert {r.url.removeprefix(site) for r in got.collect()} == {"/", "/a", "/b", "/late"}


def test_batches_that_are_played_again_give_nothing_and_leave_no_state(spark, tmp_path):
    seen, given = SeenUrls(spark, per_bucket=20), []
    source = str(tmp_path / "in")
    for turn in range(3):
        frame(spark, [f"http://s/{i}" for i in range(turn * 15, turn * 15 + 30)] * 2).coalesce(1).write.mode("append").parquet(source)
        # a new checkpoint plays all batches again
        stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(source)
        query = frontier.feed_new(stream, seen, lambda new, _: given.extend(r.url for r in new.collect()), str(tmp_path / f"check{turn}"))
        assert query.awaitTermination(180) and query.exception() is None
        assert all(not p.stateOperators for p in query.recentProgress)
    assert Counter(given) == Counter(f"http://s/{i}" for i in range(60))


def test_sites_are_paced_apart(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(f"http://s{i % 2}", f"http://s{i % 2}/{i}") for i in range(6)] + [("http://t", "http://t/0")]
    spark.createDataFrame(rows, "site string, url string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("site string, url string").parquet(source)
    query = frontier.paced(stream, 1.0).writeStream.format("memory").queryName("paced").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 120
        while time.time() < until and spark.table("paced").count() < 7:
            time.sleep(0.5)
        got = defaultdict(list)
        for r in spark.table("paced").orderBy("release_ms").collect():
            got[r.site].append((r.release_ms, r.url))
    finally:
        query.stop()
    # the order of the schedule, and never two within the delay
    assert {s: [u for _, u in v] for s, v in got.items()} == {"http://s0": [f"http://s0/{i}" for i in (0, 2, 4)], "http://s1": [f"http://s1/{i}" for i in (1, 3, 5)], "http://t": ["http://t/0"]}
    assert all(b[0] - a[0] >= 1000 for v in got.values() for a, b in zip(v, v[1:]))
