"""robots.txt: patterns, grammar, precedence, delays, hosts, limits, status policy."""

import itertools
import random
import re
import urllib.parse

import pytest
from pyspark.sql import functions as F

from gossamer.functions import patterns
from gossamer.operators import robots

ESC = "/foo/bar?baz=http%3A%2F%2Ffoo.bar".replace("http", "https")
PATTERNS = [
    ("", "/some/path", False), ("/some/path", "/some/other/path", False), ("/some/path/", "/some/path", False), ("/some/path", "/some/path", True), ("/some/path", "/some/path.html", True),
    ("/*?_rsc=*", "/some/", False), ("/some/path", "/some/path/subdirectory", True), *[(f"/some/path%3{a}", f"/some/path%3{b}", True) for a, b in itertools.product("cC", "cC")],
    ("/some/path%2F", "/some/path%2F", True), ("/some/path%2F", "/some/path/", False), ("/some/path/", "/some/path%2F", False),
    ("/some%2Apath", "/some%2Apath", True), ("/some%2Apath", "/some*path", True), ("/some*path", "/some*path", True), ("/some%24path", "/some%24path", True), ("/some%24path", "/some$path", True), ("/some$path", "/some$path", True),
    *[(f"/a{x}b", f"/a{y}b", True) for x, y in (("%7e", "%7e"), ("%7E", "%7e"), ("~", "%7E"), ("%7e", "~"))],
    ("/foo/bar/ツ", "/foo/bar/%E3%83%84", True), ("/foo/bar/%E3%83%84", "/foo/bar/ツ", True), ("/foo/bar/ツ", "/foo/bar/ツ", True),
    ("/a*b$", "/aXbYb", False), ("/a*$", "/abc", False), ("/a*b$", "/aXb", True), ("/a+b", "/a+b", True), ("/a%zz", "/a%zz", True), ("/a\\Eb", "/a\\Eb", True), ("/x$", "/x", True), ("/x$", "/xy", False), ("/a.c", "/abc", False),
]


def test_patterns(spark):
    frame = spark.createDataFrame([(i, p, x) for i, (p, x, _) in enumerate(PATTERNS)], "i int, p string, x string")
    hit = patterns.matches(F.col("p"), patterns.pattern_regex(F.col("p")), patterns.normalized_path(F.col("x")))
    got = [r.v for r in frame.select("i", hit.alias("v")).orderBy("i").collect()]
    assert [(p, x, g) for (p, x, _), g in zip(PATTERNS, got)] == PATTERNS


def grouped(spark, *texts):
    return robots.grouped(robots.lines(spark.createDataFrame(list(enumerate(texts)), "site int, txt string").withColumn("site", F.col("site").cast("string"))))


def allowed(spark, cases):
    """cases: (text, agent, path) -> bool"""
    paths = spark.createDataFrame([(str(i), a, p) for i, (_, a, p) in enumerate(cases)], "site string, agent string, path string")
    rows = robots.check(paths, grouped(spark, *[t for t, _, _ in cases])).collect()
    return [r.allowed for r in sorted(rows, key=lambda r: int(r.site))]


CHECKS = [
    ("User-agent: *\nDisallow: /some/path", "SomeBot", "/some/other/path", True),
    ("User-agent: *\nDisallow: /", "SomeBot", "/robots.txt", True),
    ("User-agent: *\nDisallow: /", "SomeBot", "/x", False),
    ("User-agent: *\nDisallow: /*/dir", "SomeBot", "/any/dir/x", False),
    ("User-agent: *\nDisallow: /**/dir", "SomeBot", "/any/dir", False),
    ("User-agent: *\nDisallow: /some/path$", "SomeBot", "/some/path", False),
    ("User-agent: *\nDisallow: /some/path$", "SomeBot", "/some/path/sub", True),
    ("User-agent: SomeBot\nDisallow: /\n\nUser-agent: *\nDisallow: ", "somebot", "/x", False),
    ("User-agent: SomeBot\nDisallow: \n\nUser-agent: *\nDisallow: /", "SomeBot", "/x", True),
    ("User-agent: Other\nDisallow: /\n", "SomeBot", "/x", True),
    ("User-agent: A\nUser-agent: B\nDisallow: /x", "b", "/x", False),
    ("User-agent: A\n# note\nUser-agent: B\nDisallow: /x", "a", "/x", False),
    ("User-agent: A\n\nUser-agent: B\nDisallow: /x", "a", "/x", True),
    ("User-agent: A\nDisallow: /x\n\nUser-agent: A\nDisallow: /y", "a", "/y", False),
    ("User-agent: *\nDisallow: /some\nAllow: /some/path", "a", "/some/path", True),
    ("User-agent: *\nAllow: /some\nDisallow: /some/path", "a", "/some/path", False),
    ("User-agent: *\nDisallow: /path\nAllow: /path", "a", "/path", True),
    ("User-agent: *\nDisallow: /x # comment", "a", "/x", False),
    ("User-agent: *\nDisallow:/x", "a", "/x", True),
    ("user-agent: *\ndisallow: /x", "a", "/x", False),
    ("User-agent: *\n Disallow: /x", "a", "/x", True),
    ("User-agent: Bad/1.0\nDisallow: /x", "a", "/x", True),
    ("User-agent: A\nUser-agent: Bad/1\nDisallow: /x", "a", "/x", False),
    ("", "a", "/x", True),
    ("User-agent: *\nDisallow: /X", "a", "/x", True),
]


def test_checks(spark):
    assert allowed(spark, [c[:3] for c in CHECKS]) == [c[3] for c in CHECKS]


def test_facts_before_groups(spark):
    rows = grouped(spark, "Host: robots.github.com\nSitemap: http://a/s.xml\nSitemap: /relative\nUser-agent: *\nHost: no.org\nSitemap: http://b", "host: https://robots.github.com/x\nHost: second.org", "Host: ..\nHost: ok.org", "Host: a:b:zz\nHost: 2001:db8::1", "Host: http://[::1]:80/x")
    assert {r.site: r.host for r in robots.hosts(rows).collect()} == {"0": "robots.github.com", "1": "robots.github.com", "2": "ok.org", "3": "2001:db8::1", "4": "[::1]"}
    assert [r.sitemap for r in robots.sitemaps(rows).collect()] == ["http://a/s.xml"]
    sites = spark.createDataFrame([("0",), ("9",)], "site string")
    assert {tuple(r) for r in robots.sitemap_locations(sites, robots.sitemaps(rows)).collect()} == {("0", "http://a/s.xml"), ("9", "9/sitemap.xml")}


def test_delays(spark):
    text = "User-agent: A\nCrawl-delay: 15\nCrawl-delay: 5\n\nUser-agent: a\nCrawl-delay: 7\n\nUser-agent: *\nCrawl-delay: 3\n\nUser-agent: none\nDisallow: /\nCrawl-delay: 1.5"
    asked = spark.createDataFrame([("0", a) for a in ("A", "none", "other")], "site string, agent string")
    assert {r.agent: r.delay for r in robots.delay_for_agent(asked, grouped(spark, text)).collect()} == {"A": 15, "none": None, "other": 3}


def test_limits_and_status(spark):
    texts = spark.createDataFrame([("big", "#" * (500 * 1024 + 1)), ("fits", "a" * (500 * 1024))], "site string, txt string")
    assert [r.site for r in robots.errors(texts).collect()] == ["big"]
    assert [r.site for r in robots.lines(texts).collect()] == ["fits"]
    codes = [500, 501, 503, 599, 400, 401, 404, 499, 200, 201, 204, 299]
    frame = spark.createDataFrame([(str(c), c, "User-agent: *\nDisallow: /no") for c in codes], "site string, status int, body string")
    paths = frame.select("site", F.lit("bot").alias("agent"), F.explode(F.array(F.lit("/"), F.lit("/no"))).alias("path"))
    got = {(r.site, r.path): r.allowed for r in robots.check(paths, robots.grouped(robots.lines(robots.texts_by_status(frame)))).collect()}
    for c in codes:
        assert (got[str(c), "/"], got[str(c), "/no"]) == ((False, False) if c >= 500 else (True, True) if c >= 400 else (True, False))


def model(text, agent, path):
    """A slow reading of the grammar, line by line, as the oracle of random texts."""
    rules, current, flag = {}, set(), False
    for line in re.split("\r\n|\n|\r", text):
        if line.startswith("#"):
            continue
        m = re.match("(?i)(user-agent|crawl-delay|host|sitemap|allow|disallow): ([^ ]*)", line)
        name, value = (m[1].lower(), m[2]) if m else ("", "")
        if name == "user-agent":
            if not flag:
                current = set()
            if value == "*" or re.fullmatch("[a-zA-Z_-]+", value):
                current.add(value.lower())
                rules.setdefault(value.lower(), [])
                flag = True
            continue
        flag = False
        if name in ("allow", "disallow"):
            for a in current:
                rules[a].append((name == "allow", value))
    own = rules.get(agent.lower(), rules.get("*", []))
    norm = lambda v: urllib.parse.unquote(v) if re.search("%(?!2[fF])", v) else v

    def hit(p):
        if not p:
            return False
        parts, x = [norm(q) for q in p.removesuffix("$").split("*")], norm(path)
        if not x.startswith(parts[0]):
            return False
        at = len(parts[0])
        for q in parts[1:]:
            if (k := x.find(q, at)) < 0:
                return False
            at = k + len(q)
        return not p.endswith("$") or at == len(x)

    found = [(len(p), a) for a, p in own if hit(p)]
    return path == "/robots.txt" or not found or max(found)[1]


def test_random_texts(spark):
    rng = random.Random(3)
    piece = ["User-agent: *", "User-agent: a", "User-agent: B", "user-agent: x/1", "# c", "", "Disallow: /", "Allow: /p", "Disallow: /p*q", "Disallow: /p/q$", "Allow: /p/%71", "Disallow: ", "Crawl-delay: 2", "Host: h.org", "Disallow: /*r", "Allow: /p/q"]
    cases = [("\n".join(rng.choice(piece) for _ in range(rng.randrange(12))), rng.choice(["A", "b", "c"]), rng.choice(["/p", "/p/q", "/p/r", "/", "/pxq", "/robots.txt"])) for _ in range(300)]
    assert allowed(spark, cases) == [model(*c) for c in cases]


@pytest.mark.parametrize("name", ["gossamer.operators.robots", "gossamer.plans.catalog"])
def test_the_rest_does_not_need_llm(name):
    import importlib

    source = open(importlib.import_module(name).__file__).read()
    assert "gossamer.llm" not in source


def test_rules_are_looked_up_by_their_beginnings(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rules = [(rng.random() < 0.5, rng.choice([f"/{word()}", f"/{word()}/{word()}", f"/{word()}/{word()}$", f"/{word()}/*{word()}", f"/*{word()}*{word()}$", f"/*.{word()[:3]}$", f"/%7{rng.randint(0, 9)}{word()}"])) for _ in range(3000)]
    rules += [(False, "/"), (True, "/*a*$"), (False, "*zz"), (True, ""), (False, "$"), (True, "/*%2Fab*"), (False, "/caf%C3%A9*e")]
    text = "User-agent: *\n" + "\n".join(f"{'Allow' if allow else 'Disallow'}: {p}" for allow, p in rules)
    groups = robots.grouped(robots.lines(spark.createDataFrame([("s", text)], "site string, txt string")))
    own = robots.rules(groups)
    paths = {p.replace("*", word()).rstrip("$") + rng.choice(["", word(), "/" + word()]) for _, p in rng.sample(rules, 400)} | {"/", "", "/café/xe", "/a%2Fabc", "azz", "/%70x"}
    asked = spark.createDataFrame([("s", "*", p) for p in paths], "site string, agent string, path string").withColumn("norm_path", patterns.normalized_path(F.col("path")))
    met = robots.candidates(asked, own).select("path", "pattern", "allow", "regex", "norm_path", "len").collect()
    assert len(met) < 40 * len(paths)
    every = asked.join(own.drop("agent", "site")).where(patterns.matches(F.col("pattern"), F.col("regex"), F.col("norm_path")))
    want = {(r.path, r.pattern, r.allow) for r in every.collect()}
    got = {(r.path, r.pattern, r.allow) for r in robots.candidates(asked, own).where(patterns.matches(F.col("pattern"), F.col("regex"), F.col("norm_path"))).collect()}
    assert got == want and len(want) > 400
    sure = {(r.path, r.pattern, r.allow) for r in met if "*" not in r.pattern}
    assert sure == {w for w in want if "*" not in w[1]}
