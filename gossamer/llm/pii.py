"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four patterns with validity tests.  Beyond them, looser candidates are judged: spelt-out
addresses, telephone numbers without a plus sign or with 00, addresses of the sixth internet protocol, numbers
of a card's length whose checksum fails, and values given to a name such as token or password (kind "secret").
Five labelers vote 1, -1 or 0 (abstains): shape (regex), checksum, range or variety of characters, a gazetteer
of known domains, calling codes, issuers, reserved networks and names of credentials, words in front, and
neighbouring characters.  Expectation-maximisation over the counts of vote patterns estimates every labeler's
reliability without labels; its posteriors train a logistic span classifier over votes, kind, form and length.
Candidates of at least THRESHOLD that overlap no base span are added; one that fails its checksum only where
the words in front name its kind.  Of added spans that overlap, the first in order stays.

Texts are searched once: base spans and votes are staged, without the texts.  Counts are grouped before they
reach the driver: at most 5 kinds x 2 forms x 3^5 votes x 4 length classes, 9,720 rows whatever the input.

Defined results: null and empty texts have no spans; positions are code points, end exclusive; repeated
rows are handled row by row; a corpus without candidates adds nothing; an empty table has no rows; columns of
the table named base or added are replaced, all others are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
#: What is added may be of one more kind.
ALL_KINDS = (*KINDS, "secret")
THRESHOLD = 0.5
VOTES = 5
_LOCAL = "A-Za-z0-9._%+-"
#: Possessive forms of the base patterns: a run that fails is left at once, so that long runs cost linear time.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # from the start of a run: shorter runs are never valid
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}+:){7}[0-9a-f]{1,4}+(?![0-9a-f:.])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.-])00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,8}){2,4}(?![0-9A-Za-z])",
    # the value alone: the name and the sign before it are looked back at
    "secret": r"(?i)(?<=(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)[\"']?\s{0,2}[:=]\s{0,2}[\"']{0,1})[A-Za-z0-9+/_=.~-]{12,}+",
}
#: Text that must be in a document for a pattern to be worth running.
HINT = {
    "base": {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"},
    "loose": {"email": r"[\[(]at[\])]", "ip": "(?i)[0-9a-f]:[0-9a-f]", "phone": "[0-9]{3}[) .-]", "secret": r"[:=]\s{0,2}[\"']?[A-Za-z0-9+/_=.~-]{12}"},
}
BEFORE = 24
WORDS = {
    "email": "mail|correo|courriel|contact",
    "ip": "host|server|addr|\\bip\\b|login",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|fax|mobil|cell",
    "secret": "token|secret|passw|key|credential|auth|bearer",
}
OTHER_WORDS = "order|invoice|isbn|issn|version|serial|part|build|page|figure|commit|sha|digest|checksum"
#: Known entries, looked up whole: last label of a domain, first digits of a number, first octet, name before a value.
GAZETTEER = {
    "email": "com org net edu gov mil int info biz io dev app ai co me tv eu de at ch fr es it nl be uk ie pt pl cz se no fi dk ru ua tr gr jp cn kr in au nz ca us mx br ar cl za".split(),
    # networks that no host on the internet has
    "ip": "0 10 127 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 246 247 248 249 250 251 252 253 254 255".split(),
    "card": "34 37 36 38 39 30 35 40 41 42 43 44 45 46 47 48 49 51 52 53 54 55 22 23 24 25 26 27 60 62 64 65 50 56 57 58 67".split(),
    "phone": "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420 421 972".split(),
    "secret": "token secret password passwd api_key api-key apikey access_key access-key accesskey private_key private-key privatekey credential".split(),
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)


#: Matches whose places are added up in one go: appending to an array copies it, so a text's arrays stay short.
RUN = 256


def _cut(text: Column, pattern: str, matches: Column) -> Column:
    """The matches, each with what stands before it (from split())."""
    return F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("hit"))


def _runs(pieces: Column) -> Column:
    last = F.floor((F.greatest(F.size(pieces), F.lit(1)) - 1) / RUN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(pieces, k * RUN + 1, F.lit(RUN)))


def _located(runs: Column) -> Column:
    """The matches as structs (start, end, text)."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))

    def length(xs):
        return F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"]))

    begins = F.aggregate(runs, F.array(F.lit(0)), lambda at, xs: F.concat(at, F.array(F.element_at(at, -1) + length(xs))))
    return F.flatten(F.zip_with(runs, F.slice(begins, F.lit(1), F.size(runs)), lambda xs, begin: F.aggregate(xs, F.struct(begin.alias("at"), none.alias("out")), step, lambda a: a["out"])))


def located(docs: DataFrame) -> DataFrame:
    """`docs` (with columns text and _-names of its own only) and an array column of located matches per pattern."""
    text = F.coalesce("text", F.lit(""))
    matches, pieces, runs, found = {}, {}, {}, {}
    for form, patterns in (("base", BASE), ("loose", LOOSE)):
        for kind, pattern in patterns.items():
            hint = HINT[form][kind]
            every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            worth = text.contains(hint) if hint == "@" else text.rlike(hint)
            matches[f"_m_{form}_{kind}"] = F.when(worth, every).otherwise(F.array().cast("array<string>"))
            # each step is a column of its own: what a lambda refers to is computed again for every element
            pieces[f"_p_{form}_{kind}"] = _cut(text, pattern, F.col(f"_m_{form}_{kind}"))
            runs[f"_r_{form}_{kind}"] = _runs(F.col(f"_p_{form}_{kind}"))
            found[f"_{form}_{kind}"] = _located(F.col(f"_r_{form}_{kind}"))
    return docs.withColumns(matches).withColumns(pieces).withColumns(runs).withColumns(found).drop(*matches, *pieces, *runs)


def base_spans() -> Column:
    """All valid base spans as structs (start, place of the kind, end, kind)."""

    def of(kind: str) -> Column:
        good = F.filter(F.col(f"_base_{kind}"), lambda x: _valid(kind, x["text"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*map(of, KINDS)))


def _sign(good: Column, bad: Column | None = None) -> Column:
    return F.when(good, 1).when(bad if bad is not None else F.lit(True), -1).otherwise(0)


def _known(kind: str, hit: Column, before: Column) -> Column:
    """The gazetteer's vote."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    listed = GAZETTEER[kind]
    if kind == "email":
        return _sign(F.lower(F.element_at(F.split(F.regexp_replace(hit, r"(?i) ?[\[(]dot[\])] ?", "."), r"\."), -1)).isin(listed))
    if kind == "ip":
        return F.when(hit.contains(":"), 0).otherwise(_sign(~F.element_at(F.split(hit, r"\."), 1).isin(listed)))
    if kind == "card":
        return _sign(digits.substr(1, 2).isin(listed))
    if kind == "phone":
        code = F.regexp_replace(F.regexp_replace(hit, r"^00", "+"), r"[^0-9+]", "")
        return F.when(~code.startswith("+"), 0).otherwise(_sign(code.substr(2, 1).isin(listed) | code.substr(2, 2).isin(listed) | code.substr(2, 3).isin(listed)))
    return _sign(F.regexp_extract(before, r"([a-z_-]+)[\"']?\s*[:=]\s*[\"']?$", 1).isin(listed))


def _judged(kind: str, form: str, x: Column, text: Column) -> Column:
    """The candidate `x` with its five votes, packed as base 3 digits, and its length class."""
    hit = x["text"]
    before = F.lower(text.substr(F.greatest(x["start"] - BEFORE, F.lit(0)) + 1, x["start"] - F.greatest(x["start"] - BEFORE, F.lit(0))))
    after = text.substr(x["end"] + 1, F.lit(1))
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    shape = {
        "email": F.length(hit).between(6, 120) & ~hit.rlike(r"\.\.|^[.%+-]"),
        "ip": hit.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|:"),
        "card": digits.isin(14, 15, 16),
        "phone": hit.rlike(r"[() .-]") & digits.between(9, 13),
        "secret": hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"),
    }[kind]
    right = {
        "email": ~hit.rlike(r"-\.|\.-|@-"),
        "ip": _valid("ip", hit) | hit.contains(":"),
        "card": _valid("card", hit),
        "phone": digits.between(9, 15),
        "secret": F.size(F.array_distinct(F.split(hit, ""))) >= 10,
    }[kind]
    votes = [
        _sign(shape),
        _sign(right),
        _known(kind, hit, before),
        _sign(before.rlike(WORDS[kind]), before.rlike(OTHER_WORDS)),
        _sign(~before.rlike(r"[\p{L}0-9]$") & ~after.rlike(r"^[\p{L}0-9]")),
    ]
    packed = sum(((v + 1) * 3**k for k, v in enumerate(votes)), F.lit(0))
    return F.struct(x["start"].alias("start"), F.lit(ALL_KINDS.index(kind)).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(int(form == "loose")).alias("loose"), packed.alias("votes"), F.least(F.length(hit) / 8, F.lit(3)).cast("int").alias("size"), (_valid(kind, hit) if form == "base" else F.lit(False)).alias("is_base"))


def candidates() -> Column:
    """Every base match, valid or not, and every loose match, judged; email and ip matches are few in kind."""
    text = F.coalesce("text", F.lit(""))

    def of(form: str, kind: str) -> Column:
        own = F.col(f"_{form}_{kind}")
        if form == "base" and kind == "card":
            own = F.filter(own, lambda x: F.length(F.regexp_replace(x["text"], r"[\x20-]", "")) <= 19)
        return F.transform(own, lambda x: _judged(kind, form, x, text))

    return F.concat(*[of("base", k) for k in BASE], *[of("loose", k) for k in LOOSE])


def _digits(votes: int) -> list[int]:
    return [votes // 3**k % 3 - 1 for k in range(VOTES)]


def fit(counts: list[tuple[int, int, int, int, int]], rounds: int = 40) -> dict:
    """EM over (place, loose, votes, size, count) rows, then the classifier that its posteriors train."""
    by_kind: dict[int, dict[int, float]] = {}
    for place, _, votes, _, n in counts:
        by_kind.setdefault(place, {}).setdefault(votes, 0.0)
        by_kind[place][votes] += n
    posterior: dict[tuple[int, int], float] = {}
    for place, patterns in by_kind.items():
        prior = 0.5
        # chance of each vote (-1, 0, 1) for true and false candidates, at first slightly better than even
        chance = [[[0.25, 0.25, 0.5], [0.5, 0.25, 0.25]] for _ in range(VOTES)]
        for _ in range(rounds):
            soft = {}
            for votes in patterns:
                like = [prior, 1 - prior]
                for k, v in enumerate(_digits(votes)):
                    like = [like[c] * chance[k][c][v + 1] for c in (0, 1)]
                soft[votes] = like[0] / (like[0] + like[1])
            total = sum(patterns.values())
            true = sum(n * soft[v] for v, n in patterns.items())
            prior = min(0.99, max(0.01, (true + 1) / (total + 2)))
            for k in range(VOTES):
                for c in (0, 1):
                    seen = [1.0, 1.0, 2.0] if c == 0 else [2.0, 1.0, 1.0]
                    for votes, n in patterns.items():
                        seen[_digits(votes)[k] + 1] += n * (soft[votes] if c == 0 else 1 - soft[votes])
                    chance[k][c] = [s / sum(seen) for s in seen]
        posterior |= {(place, v): p for v, p in soft.items()}
    rows = [([1.0, *(float(place == k) for k in range(len(ALL_KINDS))), float(loose), *map(float, _digits(votes)), size / 3], posterior[place, votes], math.log1p(n)) for place, loose, votes, size, n in counts]
    weights = [0.0] * (3 + len(ALL_KINDS) + VOTES)
    mass = sum(n for *_, n in rows) or 1.0
    for _ in range(300):
        slope = [0.0] * len(weights)
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True))))))
            for k, b in enumerate(x):
                slope[k] += n * (p - y) * b
        weights = [w - 1.0 * (s / mass + 1e-3 * w) for w, s in zip(weights, slope, strict=True)]
    return {"weights": weights}


def _vote(x: Column, k: int) -> Column:
    return F.floor(x["votes"] / 3**k) % 3 - 1


def _probability(x: Column, weights: list[float]) -> Column:
    n = 1 + len(ALL_KINDS)
    total = F.lit(weights[0]) + F.lit(weights[n]) * x["loose"] + F.lit(weights[n + 1 + VOTES]) * x["size"] / 3
    for k in range(len(ALL_KINDS)):
        total += F.when(x["place"] == k, weights[1 + k]).otherwise(0.0)
    for k in range(VOTES):
        total += F.lit(weights[n + 1 + k]) * _vote(x, k)
    return 1 / (1 + F.exp(-total))


def _judged_spans(rows: DataFrame) -> DataFrame:
    """row, base, added of `rows` (row, text): base spans, and spans that the classifier adds."""
    found = stage(located(rows).select("row", base_spans().alias("base"), candidates().alias("judged")))
    votes = found.select(F.explode("judged").alias("c")).groupBy("c.place", "c.loose", "c.votes", "c.size").count()
    weights = fit(sorted(tuple(r) for r in votes.collect()))["weights"]

    def likely(x: Column) -> Column:
        # a failed checksum needs words that name the kind
        sure = (_vote(x, 1) > 0) | (_vote(x, 3) > 0)
        return (_probability(x, weights) >= THRESHOLD) & sure & ~x["is_base"] & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    span = F.transform(F.filter("judged", likely), lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    apart = F.aggregate(
        F.array_sort(span),
        F.filter(span, lambda x: F.lit(False)),
        lambda got, x: F.when(F.coalesce(F.try_element_at(got, F.lit(-1))["end"] > x["start"], F.lit(False)), got).otherwise(F.concat(got, F.array(x))),
    )
    return found.select("row", "base", apart.alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """`docs` with base (array of base spans) and added (array of spans that the classifier adds)."""
    # own names cannot clash: the table is one struct while it is searched
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("base", "added")])
    return _judged_spans(docs.select(row.alias("row"), "text")).select("row.*", "base", "added")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    found = _judged_spans(docs.select(F.struct("doc_id").alias("row"), "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("row.doc_id", *map(count, KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "added"))).alias("spans"))
