"""The trie of all prefixes of conversations, built by halving depths.

A turn is named by a digest of role and text.  BLOCK turns of a conversation make a block, whose prefixes are
named inside one row.  Blocks make segments of 2, 4, 8, .. blocks: going up, a segment is named by the names of
its halves; going down, a sequence is cut at half depth and the cut prefix is named by the prefix before the
segment and the name of its upper half, so that the upper trie and the lower forests below all cut prefixes are
worked on at the same time, in as many rounds as the depth has binary digits.  Totals go the other way: what the
nodes of a block have below them inside it is added up first, then the totals of lower forests are grafted on the
ancestors of their cut prefix, level by level upward.

No step gathers a conversation, a node's members or its children in one task: long conversations are blocks,
equal prefixes meet in sums with a map-side part, a node with many children sends its owner by a broadcast of at
most HOT_PARENTS rows, and ids of members are joined to texts inside sorted ranges before the digest of each node
reads them in order, with constant memory.

Names are the first 16 bytes of SHA-256.  Defined results: null role or text is empty; turns of one number go by
role, then text; rows without conv_id belong to no conversation and take no part; repeated rows are turns of their
own; a conversation without turns ends at the root; an empty table has no rows, not even a root; further columns
are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm.common import stage

BLOCK = 8
#: Nodes with more than this share of all nodes as children, so at most as many.
HOT_PARENTS = 1000
#: A conversation begins with up to LEAD - 1 turns of the first one of its FAMILY.
LEAD, FAMILY = 6, 100
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _name(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, mid, turn_name, n_chars) in the order of ranges, and for each conversation and range
    (conv_id, part, first, before): a turn's place is mid - first + before + 1.

    Ranges split a conversation however long it is.
    """
    texts = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 16))
    ordered = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    name = _name(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    turns = stage(ordered.select("conv_id", name.alias("turn_name"), F.length("text").cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("mid")))
    turns = turns.withColumn("part", F.shiftright("mid", 33))
    ranges = turns.groupBy("conv_id", "part").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, turn_name, n_chars) of conversations as they are, and the conversations (conv_id)."""
    turns, ranges = numbered(conversations)
    rows = turns.join(ranges, ["conv_id", "part"]).select("conv_id", (F.col("mid") - F.col("first") + F.col("before") + 1).alias("pos"), "turn_name", "n_chars")
    return rows, ranges.select("conv_id").distinct()


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like plain(), each conversation with its first turns taken from the first one of its family."""
    turns, ranges = numbered(conversations)
    ranges = stage(ranges)
    convs = ranges.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEAD})
    heads = convs.select(F.col("conv_id").alias("base"), F.least("n", F.lit(LEAD - 1)).alias("base_n"))
    convs = stage(convs.join(heads, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv_id", "base", "h", "lead"))
    placed = turns.join(ranges.join(convs, "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("mid") - F.col("first") + F.col("before") + 1)
    placed = stage(placed.select("conv_id", "pos", "turn_name", "n_chars", "h", "lead"))
    own = placed.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "turn_name", "n_chars")
    head = placed.where((F.col("pos") < LEAD) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "turn_name", "n_chars")
    taken = convs.where("lead > 0").join(head, "base").where("pos <= lead").select("conv_id", "pos", "turn_name", "n_chars")
    return own.unionByName(taken), convs.select("conv_id")


def _paths(turns: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(conv_id, b, before, names, chars): for each block the name of the prefix before it and those of the prefixes
    that end in it; and the number of levels of segments."""
    place = F.col("pos") - 1
    rows = turns.select("conv_id", F.floor(place / block).cast("long").alias("b"), F.struct(place.alias("at"), "turn_name", "n_chars").alias("turn"))
    rows = rows.groupBy("conv_id", "b").agg(F.sort_array(F.collect_list("turn")).alias("turns"))  # `block` turns at most

    def longer(done: Column, turn: Column) -> Column:
        last = F.when(F.size(done) == 0, F.lit(b"").cast("binary")).otherwise(F.element_at(done, -1))
        return F.concat(done, F.array(_name(last, turn["turn_name"])))

    inside = F.aggregate("turns", F.array().cast("array<binary>"), longer)
    blocks = stage(rows.select("conv_id", "b", inside.alias("inside"), F.col("turns.n_chars").alias("chars")))
    levels = int(blocks.agg(F.coalesce(F.max("b"), F.lit(0))).first()[0]).bit_length()
    full = F.when(F.size("inside") == block, F.element_at("inside", -1))
    root = F.lit(ROOT).cast("binary")
    if not levels:
        return stage(_named(blocks.withColumns({"before": root, "after": _name(root, full)}), block)), 0

    # upward: segments of whole blocks are named by their halves
    named = [blocks.where(full.isNotNull()).select("conv_id", F.col("b").alias("q"), full.alias("name"))]
    for _ in range(levels):
        left, right = F.max(F.when(F.col("q") % 2 == 0, F.col("name"))), F.max(F.when(F.col("q") % 2 == 1, F.col("name")))
        pair = named[-1].groupBy("conv_id", F.floor(F.col("q") / 2).alias("q")).agg(left.alias("l"), right.alias("r"))
        named.append(stage(pair.where("l is not null and r is not null").select("conv_id", "q", _name(F.col("l"), F.col("r")).alias("name"))))

    # downward: the prefixes before and after every half
    whole = named[levels].select("conv_id", "name")
    segments = blocks.groupBy("conv_id").agg((F.max("b") + 1).alias("n")).join(whole, "conv_id", "left")
    segments = segments.select("conv_id", "n", F.lit(0).cast("long").alias("q"), root.alias("before"), _name(root, F.col("name")).alias("after"))
    for k in reversed(range(levels)):
        upper = named[k].where("q % 2 = 0").select("conv_id", F.floor(F.col("q") / 2).alias("q"), "name")
        cut = _name(F.col("before"), F.col("name"))
        half = lambda q, before, after: F.struct(q.alias("q"), before.alias("before"), after.alias("after"))
        first, second = half(2 * F.col("q"), F.col("before"), cut), half(2 * F.col("q") + 1, cut, F.col("after"))
        halves = F.when(F.col("n") > (2 * F.col("q") + 1) * (1 << k), F.array(first, second)).otherwise(F.array(first))
        segments = stage(segments.join(upper, ["conv_id", "q"], "left").select("conv_id", "n", F.explode(halves).alias("s")).select("conv_id", "n", "s.*"))
    around = segments.select("conv_id", F.col("q").alias("b"), "before", "after")
    return stage(_named(blocks.join(around, ["conv_id", "b"]), block)), levels


def _named(blocks: DataFrame, block: int) -> DataFrame:
    names = F.transform("inside", lambda name, i: F.when(i == block - 1, F.col("after")).otherwise(_name(F.col("before"), name)))
    return blocks.select("conv_id", "b", "before", names.alias("names"), "chars")


def _nodes(paths: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(name, depth, owner, parent, n_convs, saved) of every node but for its totals."""
    steps = paths.select("conv_id", "b", "before", "names", F.posexplode(F.arrays_zip("names", "chars")).alias("i", "step"))
    parent = F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("names", F.col("i") - 1))
    steps = steps.select("conv_id", (F.col("b") * block + F.col("i") + 1).alias("depth"), F.col("step.names").alias("name"), parent.alias("parent"), F.col("step.chars").alias("chars"))
    nodes = steps.groupBy("depth", "name").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("chars").alias("chars"))
    nodes = nodes.select("name", "depth", "owner", "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    root = members.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).cast("binary").alias("name"), F.lit(0).cast("long").alias("depth"), "owner", F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("saved"))
    return stage(nodes.unionByName(root))


def _related(nodes: DataFrame) -> DataFrame:
    """Adds n_children and parent_owner to nodes."""
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    limit = max(HOT_PARENTS, nodes.count() // HOT_PARENTS)
    owners = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("owner").alias("parent_owner"), "n_children")
    hot = owners.where(F.col("n_children") > limit).drop("n_children")  # at most HOT_PARENTS rows
    told = nodes.join(F.broadcast(hot), "parent", "left")
    rest = told.where("parent_owner is null").drop("parent_owner").join(owners.where(F.col("n_children") <= limit).drop("n_children"), "parent", "left")
    return stage(told.where("parent_owner is not null").unionByName(rest))


def _totals(nodes: DataFrame, paths: DataFrame, levels: int, block: int) -> DataFrame:
    """(name, n_leaves, saved_tokens) of the subtrees of all nodes but the root."""
    own = nodes.where("depth > 0").select("owner", F.floor((F.col("depth") - 1) / block).cast("long").alias("b"), F.struct(((F.col("depth") - 1) % block).alias("i"), (F.col("n_children") == 0).cast("long").alias("leaf"), "saved").alias("v"))
    own = own.groupBy(F.col("owner").alias("conv_id"), "b").agg(F.collect_list("v").alias("vs"))  # `block` values at most
    add = lambda field, i: F.aggregate(F.filter("vs", lambda v: v["i"] >= i), F.lit(0).cast("long"), lambda t, v: t + v[field])
    below = F.transform("names", lambda name, i: F.struct(name.alias("name"), add("leaf", i).alias("n_leaves"), add("saved", i).alias("saved_tokens")))
    gather = lambda parts: parts.groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    totals = stage(gather(paths.join(own, ["conv_id", "b"]).select(F.inline(below))))
    for k in range(levels):
        span = block << k  # turns of a segment
        tops = nodes.where(((F.col("depth") - 1) % span == 0) & (F.floor((F.col("depth") - 1) / span) % 2 == 1)).select("name", "parent_owner", (F.floor((F.col("depth") - 1) / span).cast("long") * (1 << k)).alias("cut"))
        forests = tops.join(totals, "name").groupBy("parent_owner", "cut").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        above = forests.select(F.col("parent_owner").alias("conv_id"), F.explode(F.sequence(F.col("cut") - (1 << k), F.col("cut") - 1)).alias("b"), "n_leaves", "saved_tokens")
        grafts = above.join(paths.select("conv_id", "b", "names"), ["conv_id", "b"]).select(F.explode("names").alias("name"), "n_leaves", "saved_tokens")
        totals = stage(gather(totals.unionByName(grafts)))
    return totals


def _ends(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(name, ends_sha256) of nodes at which conversations end."""
    last = paths.groupBy("conv_id").agg(F.max_by(F.element_at("names", -1), "b").alias("name"))
    ends = members.join(last, "conv_id", "left").select(F.coalesce("name", F.lit(ROOT).cast("binary")).alias("name"), "conv_id")

    def texts(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begins = [i for i in range(len(ids)) if not i or names[i] != names[i - 1]]
            runs = [",".join(map(str, ids[i:j])) for i, j in zip(begins, [*begins[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in begins], pa.binary()), pa.array(np.array(ids, np.int64)[begins]), pa.array(runs, pa.string())], names=["name", "first", "ids"])

    def digests(batches):
        import pyarrow as pa

        name, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != name:
                    if state:
                        done.append((name, state.hexdigest()))
                    name, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["name", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    sorted_ids = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    runs = sorted_ids.mapInArrow(texts, "name binary, first long, ids string")
    return runs.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digests, "name binary, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of `turns` (conv_id, pos from 1, turn_name, n_chars) of `members` (conv_id, each once).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    paths, levels = _paths(turns, block)
    nodes = _related(_nodes(paths, members, block))
    totals = _totals(nodes, paths, levels, block)
    top = nodes.where("depth = 1").join(totals, "name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    top = top.select(F.lit(ROOT).cast("binary").alias("name"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"))
    full = nodes.join(totals.unionByName(top), "name").join(_ends(paths, members), "name", "left")
    counts = [F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return full.select(F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), *counts, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def report(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of rebuilt conversations (conv_id, turn, role, text)."""
    turns, members = rebuilt(conversations)
    return trie(turns, members, block)


#: The same by comparing whole lists of turns; crc32 is spelt out, bit by bit.
ORACLE = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(x ORDER BY pos) AS own, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % {LEAD} AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS turns FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
s AS (SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends FROM r, range(100000) AS g(d) WHERE d <= len(turns)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS members,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(path[-1].t) END AS saved FROM s GROUP BY path, depth),
k AS (SELECT n.*, p.conv_id AS parent_conv_id, count(*) OVER (PARTITION BY n.path[1:n.depth - 1], n.depth) AS siblings FROM n LEFT JOIN n AS p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
m AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN m USING (path, depth)),
u AS (SELECT path[1:d] AS path, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM v, range(100000) AS g(d) WHERE d <= depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(members) AS ends_sha256 FROM v JOIN u USING (path, depth)"""
