"""robots.txt as relations: lines, groups, rules, delays, site facts, and the check of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import patterns

# The directives, and the size limit in bytes.
DIRECTIVES = ("User-agent", "Crawl-delay", "Host", "Sitemap", "Allow", "Disallow")
MAX_BYTES = 500 * 1024


def lines(texts: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(site, line_no, line) of `texts` (site, txt) without comment lines.

    A text above the size limit gives no lines; see errors().
    """
    small = texts if max_bytes is None else texts.where(F.octet_length("txt") <= max_bytes)
    return small.select("site", F.posexplode(F.split("txt", "\r\n|\n|\r", -1)).alias("line_no", "line")).where(~F.col("line").startswith("#"))


def errors(texts: DataFrame) -> DataFrame:
    return texts.where(F.octet_length("txt") > MAX_BYTES).select("site", F.lit("robots.txt is too large").alias("error"))


def directives(line_table: DataFrame) -> DataFrame:
    """Adds directive (lower case, empty for other lines) and value (up to the first blank)."""
    pattern = "(?i)^(" + "|".join(DIRECTIVES) + "): "
    name = F.lower(F.regexp_extract("line", pattern, 1))
    return line_table.withColumns({"directive": name, "value": F.when(name != "", F.regexp_extract("line", pattern + "([^ ]*)", 2)).otherwise("")})


def grouped(line_table: DataFrame) -> DataFrame:
    """Directive lines with the agents of the group they stand in (array, empty before the first group).

    Neighbouring User-agent lines form one group; an invalid token neither joins it nor ends it; any other
    line, blank ones included, ends the run of agents but not the group.  Where a site has several texts, lines with
    the same number stand in the same group, in the order of their letters.
    """
    rows = directives(line_table)
    is_agent = F.col("directive") == "user-agent"
    good = is_agent & patterns.product_token_valid(F.col("value"))
    order, places = Window.partitionBy("site").orderBy("line_no", "line"), Window.partitionBy("site").orderBy("line_no")
    flag = F.when(is_agent & ~good, F.lit(None).cast("boolean")).otherwise(good)
    running = F.coalesce(F.last(flag, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumns({"is_agent": is_agent, "good": good}).withColumn("running", running)
    starts = F.col("is_agent") & ~F.col("running")
    rows = rows.withColumn("block", F.sum(starts.cast("int")).over(places.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    agents = F.collect_set(F.when(F.col("good"), F.lower("value"))).over(Window.partitionBy("site", "block"))
    return rows.withColumn("agents", F.array_sort(agents)).select("site", "line_no", "block", "directive", "value", "agents")


def groups(group_table: DataFrame) -> DataFrame:
    """(site, agent): every agent that has a group, even one without rules."""
    return group_table.select("site", F.explode("agents").alias("agent")).distinct()


def rules(group_table: DataFrame) -> DataFrame:
    """(site, agent, allow, pattern, len, regex, probe), distinct; patterns are compiled once, before any join."""
    kept = group_table.where(F.col("directive").isin("allow", "disallow") & (F.size("agents") > 0))
    rows = kept.select("site", F.explode("agents").alias("agent"), (F.col("directive") == "allow").alias("allow"), F.col("value").alias("pattern")).distinct()
    return rows.withColumns({"len": F.length("pattern"), "regex": patterns.pattern_regex(F.col("pattern")), "probe": patterns.probe(F.col("pattern"))})


def crawl_delays(group_table: DataFrame) -> DataFrame:
    """(site, agent, delay): the first whole number given for each agent (of several texts, the least in the first line)."""
    kept = group_table.where((F.col("directive") == "crawl-delay") & (F.size("agents") > 0) & F.col("value").rlike(r"^[+-]?[0-9]{1,10}$"))
    rows = kept.select("site", F.explode("agents").alias("agent"), "line_no", F.expr("try_cast(value AS int)").alias("delay")).where("delay IS NOT NULL")
    return rows.groupBy("site", "agent").agg(F.min_by("delay", F.struct("line_no", "delay")).alias("delay"))


def agents(group_table: DataFrame) -> DataFrame:
    """All agents with rules or delays."""
    return groups(group_table).unionByName(crawl_delays(group_table).select("site", "agent")).distinct()


def hosts(group_table: DataFrame) -> DataFrame:
    """(site, host): the first valid host named before any group (of several texts, the least in the first line); of an absolute URL its host."""
    kept = group_table.where((F.col("directive") == "host") & (F.size("agents") == 0))
    named = F.when(F.col("value").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_extract("value", r"^[A-Za-z][A-Za-z0-9+.-]*://(\[[^\]]*\]|[^/?#:]*)", 1)).otherwise(F.col("value"))
    address = F.col("host").rlike(r"^\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]$|^[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$")
    rows = kept.withColumn("host", named).where(address | F.col("host").rlike(r"^(?:[A-Za-z0-9_](?:[A-Za-z0-9_-]*[A-Za-z0-9_])?)(?:\.[A-Za-z0-9_](?:[A-Za-z0-9_-]*[A-Za-z0-9_])?)*\.?$"))
    return rows.groupBy("site").agg(F.min_by("host", F.struct("line_no", "host")).alias("host"))


def sitemaps(group_table: DataFrame) -> DataFrame:
    """(site, sitemap): the distinct absolute sitemap URLs named before any group."""
    kept = group_table.where((F.col("directive") == "sitemap") & (F.size("agents") == 0))
    return kept.where(F.col("value").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")).select("site", F.col("value").alias("sitemap")).distinct()


def sitemap_locations(sites: DataFrame, sitemap_table: DataFrame) -> DataFrame:
    """Declared sitemaps of each site, or `<site>/sitemap.xml` where it declares none."""
    return sites.join(sitemap_table, "site", "left").select("site", F.coalesce("sitemap", F.concat("site", F.lit("/sitemap.xml"))).alias("sitemap"))


def group_for_agent(asked: DataFrame, group_table: DataFrame) -> DataFrame:
    """Adds group to `asked` (site, agent): the agent's own group, else `*`, else null.

    Presence of the group counts, not of rules: an agent with an empty group does not fall back.
    """
    known = groups(group_table)
    own = known.select("site", F.col("agent").alias("_key"), F.col("agent").alias("group"))
    star = known.where("agent = '*'").select("site", F.col("agent").alias("star"))
    joined = asked.withColumn("_key", F.lower("agent")).join(own, ["site", "_key"], "left").join(star, "site", "left")
    return joined.select(*asked.columns, F.coalesce("group", "star").alias("group"))


def delay_for_agent(asked: DataFrame, group_table: DataFrame) -> DataFrame:
    """Adds delay to `asked`: the agent's own, or that of `*` only where the agent is unknown altogether."""
    delays = crawl_delays(group_table)
    own = delays.select("site", F.col("agent").alias("_a"), "delay")
    star = delays.where("agent = '*'").select("site", F.col("delay").alias("star"))
    known = agents(group_table).select("site", F.col("agent").alias("_a"), F.lit(True).alias("known"))
    rows = asked.withColumn("_a", F.lower("agent")).join(own, ["site", "_a"], "left").join(known, ["site", "_a"], "left").join(star, "site", "left")
    return rows.select(*asked.columns, F.when(F.col("known"), F.col("delay")).otherwise(F.col("star")).alias("delay"))


def rules_for_agent(asked: DataFrame, group_table: DataFrame) -> DataFrame:
    """(site, agent, allow, pattern, len, regex, probe): the rules of the group that holds for each of `asked` (site, agent)."""
    own = rules(group_table).withColumnRenamed("agent", "group")
    return group_for_agent(asked.select("site", "agent").distinct(), group_table).join(own, ["site", "group"]).drop("group")


def check(paths: DataFrame, group_table: DataFrame) -> DataFrame:
    """Adds allowed to `paths` (site, agent, path): the longest matching pattern decides, Allow before Disallow."""
    return checked(paths, rules_for_agent(paths, group_table))


def candidates(asked: DataFrame, own: DataFrame) -> DataFrame:
    """`asked` (site, agent, path, norm_path) with the rules (allow, pattern, len, regex) whose probe the path answers to.

    The probes of a site's rules say at which lengths its paths are cut, so that a path looks its rules up by
    equality: it meets those that share its beginning, not all of the site.
    """
    rule = own.where(F.length("pattern") > 0)
    length = F.when(F.col("probe").startswith("^"), F.length("probe") - 1)
    kinds = rule.groupBy("site", "agent").agg(F.collect_set(length).alias("_lengths"), F.max(F.col("probe").startswith("*")).alias("_inside"))
    probes = asked.join(kinds, ["site", "agent"]).select(*asked.columns, F.explode(patterns.path_probes(F.col("norm_path"), F.col("_lengths"), F.col("_inside"))).alias("probe"))
    return probes.join(rule, ["site", "agent", "probe"])


def checked(paths: DataFrame, own: DataFrame) -> DataFrame:
    """check() by rules_for_agent(), for which loops ask once.

    Of the candidates only those with wildcards need the regular expression; the winner is kept by a map-side max_by.
    """
    asked = paths.select("site", "agent", "path").distinct().withColumn("norm_path", patterns.normalized_path(F.col("path")))
    sure = ~F.col("pattern").contains("*")
    hit = candidates(asked, own).where(sure | patterns.matches(F.col("pattern"), F.col("regex"), F.col("norm_path")))
    winner = hit.groupBy("site", "agent", "path").agg(F.max_by("allow", F.struct("len", "allow")).alias("winner"))
    out = paths.join(winner, ["site", "agent", "path"], "left")
    return out.withColumn("allowed", (F.col("path") == "/robots.txt") | F.coalesce("winner", F.lit(True))).drop("winner")


def status_policy(status: Column) -> Column:
    """What a response to /robots.txt means: allow all, disallow all, or parse its body."""
    return F.when(status.between(400, 499), "allow").when(status >= 500, "disallow").otherwise("parse")


def texts_by_status(responses: DataFrame) -> DataFrame:
    """(site, txt) to parse from `responses` (site, status, body): empty for 4xx, `Disallow: /` for 5xx."""
    policy = status_policy(F.col("status"))
    text = F.when(policy == "allow", "").when(policy == "disallow", "User-agent: *\nDisallow: /").otherwise(F.coalesce("body", F.lit("")))
    return responses.select("site", text.alias("txt"))
