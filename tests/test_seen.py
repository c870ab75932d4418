"""The stored set of discovered URLs, and the order in which a crawl takes them."""

from __future__ import annotations

import os
import random
from collections import deque

from pyspark.sql import functions as F

from gossamer.operators import crawl
from gossamer.operators.lineage import ranked
from gossamer.operators.seen import SeenUrls
from gossamer.operators.site import crawl_site, from_store

SCHEMA = "url string, depth int"


def test_rounds_admit_each_url_once(spark):
    rng, seen, known = random.Random(1), SeenUrls(spark, per_bucket=100), set()
    for depth, size in enumerate([1, 60, 400, 5, 200, 0, 300, 7]):
        urls = {f"http://a/{rng.randint(0, 2000)}" for _ in range(size)}
        out, told = seen.admit(spark.createDataFrame([(u, depth) for u in urls], SCHEMA), deep=F.max("depth"))
        got = {r.url for r in out.collect()}
        assert got == urls - known and told["n"] == len(got)
        assert not got or told["deep"] == depth
        known |= urls
    assert {r.url for r in seen.all().collect()} == known and seen.all().columns == ["url", "depth"]
    assert seen.buckets >= 16 and len(seen.parts) < 5


def test_bytes_read_follow_the_round(spark, monkeypatch):
    seen = SeenUrls(spark, per_bucket=1000)
    known = spark.range(60_000).select(F.concat(F.lit("http://a/"), "id").alias("url"), F.lit(0).alias("depth"))
    seen.admit(known)
    size = lambda files: sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in files)
    whole, read, plain = size(seen.all().inputFiles()), [], SeenUrls._urls

    def noted(self, part, buckets=None):
        out = plain(self, part, buckets)
        if buckets is not None:
            read.append(size(f for f in out.inputFiles() if any(f"_bucket={b}/" in f for b in buckets)))
            assert "PartitionFilters: [_bucket" in out._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "").replace("(", "")
        return out

    monkeypatch.setattr(SeenUrls, "_urls", noted)
    rounds = []
    for k in range(20):
        read.clear()
        urls = [f"http://a/{60_000 * k + i}" for i in range(1 + k % 3)]
        _, told = seen.admit(spark.createDataFrame([(u, k) for u in urls], SCHEMA))
        assert told["n"] == (0 if k == 0 else len(urls))
        rounds.append(sum(read))
    assert seen.buckets >= 64
    # three URLs meet three of the buckets at most, and new ones hardly ever any
    assert max(rounds) < 0.1 * whole and sum(rounds[1:]) < whole / 4 and rounds[0] > 0


def test_ranks_are_row_numbers(spark):
    rows = ranked(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), "k").collect()
    assert all(r["rank"] == r.k for r in rows) and len(rows) == 1000


def queue(edges, entry, most):
    """What a first-in first-out queue visits, in order."""
    out, waiting, known = [], deque([entry]), {entry}
    while waiting and len(out) < most:
        page = waiting.popleft()
        out.append(page)
        for link in edges.get(page, []):
            if link not in known:
                known.add(link)
                waiting.append(link)
    return out


def test_the_cap_takes_what_a_queue_takes(spark, monkeypatch):
    monkeypatch.setattr(crawl, "LONGEST_KEY", 24)  # ranks take the place of keys every third round
    rng = random.Random(4)
    edges = {i: rng.sample([*range(i + 1, min(i + 12, 90)), *range(max(0, i - 9), i)], rng.randint(1, 4)) for i in range(90)}
    table = spark.createDataFrame([(f"u{s}", f"u{t}", k) for s, out in edges.items() for k, t in enumerate(out)], "src string, dst string, pos int")
    told = []
    got = crawl.crawl(spark.createDataFrame([("u0",)], "url string"), table, max_pages=60, on_round=told.append, per_bucket=20).orderBy("visit").collect()
    assert [r.url for r in got] == [f"u{i}" for i in queue(edges, 0, 60)]
    assert sum(r["n"] for r in told) >= 60 and [r["depth"] for r in told] == list(range(len(told)))


def test_a_capped_site_crawl_takes_what_a_queue_takes(spark):
    rng = random.Random(5)
    edges = {i: rng.sample(range(60), 3) for i in range(60)}
    rows = [(f"http://s/{i}", 200, "text/html", "".join(f"<a href='/{t}'>x</a>" for t in out)) for i, out in edges.items()]
    fetch = from_store(spark.createDataFrame(rows, "url string, status int, content_type string, body string"))
    told = []
    got = crawl_site(spark, "http://s/0", fetch, crawl.Options(max_pages=17), on_round=told.append)
    assert {r.url for r in got.collect()} == {f"http://s/{i}" for i in queue(edges, 0, 17)}
    assert sum(r["pages"] for r in told) == 17
