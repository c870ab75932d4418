"""Line dedup, Jaccard join, language model, neighbours and the pipeline against brute force."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gossamer.llm import jaccard, language_model, lines, neighbours
from gossamer.llm.components import components

DOCS = "doc_id long, text string"


def words_of(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, empty and odd texts."""
    rng = random.Random(1)
    rows, passage = [], "\n".join(" ".join(words_of(9, 900 + k)) for k in range(12))
    for i in range(60):
        rows.append((i, "\n".join(" ".join(words_of(12, 100 * i + k)) for k in range(6))))
    for i in range(60, 75):
        near = rows[i % 5][1].split(" ")
        near[rng.randrange(len(near))] = f"new{i}"
        rows.append((i, " ".join(near)))
    rows += [(75 + i, rows[7][1]) for i in range(5)]
    rows += [(80 + i, f"{rows[20 + i][1]}\n{passage}\n{' '.join(words_of(8, 5000 + i))}") for i in range(4)]
    rows += [(90, None), (91, ""), (92, ""), (93, "one two"), (94, "One, two!"), (95, " \n\n "), (7, rows[7][1]), (None, "no id at all here today")]
    rows.append((96, " ".join(words_of(30_000, 77, 5000))))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)] + [(2000, 2001 + i) for i in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in parent}
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {g for g in got if g[0] != g[1] or g in want} == {w for w in want if w in got} and {w for w in want if w[0] != w[1]} <= got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(rows):
    sets, classes = {}, defaultdict(list)
    for k, (_, t) in enumerate(rows):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        if w:
            sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
            classes[sets[k]].append(k)
    every = list(classes)
    linked = [[j for j, b in enumerate(every) if j != i and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(every)]
    group = list(range(len(every)))
    for _ in every:
        group = [min([group[i], *[group[j] for j in linked[i]]]) for i in range(len(every))]
    least = defaultdict(list)
    for i, s in enumerate(every):
        least[group[i]] += [-(1 << 63) if rows[k][0] is None else rows[k][0] for k in classes[s]]
    out = []
    for k, (d, _) in enumerate(rows):
        i = every.index(sets[k]) if k in sets else None
        out.append((d, d if i is None else min(least[group[i]]), 0 if i is None else len(linked[i])))
    return out


def test_jaccard_against_brute_force(docs):
    want = Counter((d, None if c == -(1 << 63) else c, n) for d, c, n in brute_groups(corpus()))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.report(docs).collect()) == want


def test_jaccard_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SMALL", 6)
    base = words_of(120, 3)
    rows = [(i, " ".join([*base[: i % 100], f"x{i}", *base[i % 100 + 1 :]])) for i in range(60)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: (c, n) for d, c, n in brute_groups(rows)}


def test_runs_reach_the_recall():
    assert jaccard.runs_needed(0.9) < jaccard.runs_needed(0.999) <= 12


def test_keep_first_keeps_one_of_each_group(docs):
    wide = docs.withColumns({"root": F.lit("own"), "sig": F.lit(1)})
    kept = jaccard.keep_first(wide)
    assert kept.columns == wide.columns
    want = Counter()
    seen = set()
    for (d, t), (_, c, _) in sorted(zip(corpus(), brute_groups(corpus())), key=lambda x: -(1 << 63) if x[0][0] is None else x[0][0]):
        if c not in seen:
            seen.add(c)
            want[d] += 1
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert jaccard.keep_first(docs.limit(0)).count() == 0


def brute_lines(rows):
    """What is left of each document, by the chunk rule, with all first places known."""
    rank = lambda k: (-(1 << 63) if rows[k][0] is None else rows[k][0], k)
    texts = {k: t.split("\n") for k, (_, t) in enumerate(rows) if t}
    places = defaultdict(list)
    for k, ls in texts.items():
        for at, n, _ in lines.chunks("\n".join(ls)):
            places["\n".join(ls[at : at + n]), n].append((rank(k), k, at))
    gone = defaultdict(set)
    for (_, n), found in places.items():
        (_, k0, a0), *others = sorted(found)
        for _, k, at in others:
            if rows[k] == rows[k0] and at == a0:
                continue  # a repeated row is the same document
            lo, hi = at, at + n
            x, y = texts[k], texts[k0]
            goes = [(a, m) for a, m, _ in lines.chunks("\n".join(x)) if (f := min(places["\n".join(x[a : a + m]), m]))[2] != a or rows[f[1]] != rows[k]]
            free = lambda i: not any(a <= i < a + m for a, m in goes)
            few = lambda ls: sum(len(s.split()) for s in ls) < lines.PASSAGE_WORDS
            before = next(j for j in range(len(x) + 1) if at - j - 1 < 0 or a0 - j - 1 < 0 or not free(at - j - 1) or x[at - j - 1] != y[a0 - j - 1] or not few(x[at - j - 1 : at]))
            after = next(j for j in range(len(x) + 1) if hi + j >= len(x) or a0 + n + j >= len(y) or not free(hi + j) or x[hi + j] != y[a0 + n + j] or not few(x[hi : hi + j + 1]))
            gone[k] |= set(range(lo - before, hi + after))
    return [t if not t else "\n".join(x for i, x in enumerate(texts[k]) if i not in gone[k]) for k, (_, t) in enumerate(rows)]


def test_line_dedup_against_brute_force(spark):
    rows = [r for r in corpus() if r[0] != 96]
    long = " ".join(words_of(60, 42))
    rows += [(200, f"a b\n{long}\nc d"), (201, f"{long}\ne"), (202, "x\ny\nz\n" * 4)]
    got = lines.remove(spark.createDataFrame([(*r, "s") for r in rows], DOCS + ", h string"))
    want = Counter((d, t) for (d, _), t in zip(rows, brute_lines(rows)))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    found = {r.doc_id: r for r in got.collect() if r.doc_id in (81, 82, 83, 201)}
    assert long not in found[201].text and found[201].lines_removed == 1 and found[201].chars_removed == len(long)
    passage = corpus()[80][1].split("\n")[6:18]
    assert all(sum(line in found[d].text for line in passage) == 0 for d in (81, 82, 83))
    assert lines.report(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_widens_over_many_short_lines_and_keeps_columns(spark):
    shared = "\n".join(["once upon a time there was a very long line in the text", "and a second one of nine words after it", *[""] * 30, *[f"w{i}" for i in range(14)]])
    rows = [(1, f"own first\n{shared}\nown end", 777, 8, "r"), (2, f"other first\n{shared}\nother end", 778, 9, "r"), (3, None, 779, 10, "r")]
    got = {r.doc_id: r for r in lines.remove(spark.createDataFrame(rows, DOCS + ", _id int, _th int, _ranges string")).collect()}
    assert got[2].text == "other first\nother end" and got[1].text == rows[0][1]
    assert [(r["_id"], r["_th"], r["_ranges"]) for r in map(got.get, (1, 2, 3))] == [r[2:] for r in rows]
    kept = jaccard.keep_first(spark.createDataFrame(rows, DOCS + ", _id int, _th int, _again string"))
    assert all((r["_id"], r["_th"], r["_again"]) == rows[r.doc_id - 1][2:] for r in kept.collect()) and kept.count() >= 2


def test_line_dedup_leaves_small_chunks():
    assert lines.chunks("}\n\n}\n\n}") == [] and lines.chunks("a b c\nd e f\n" * 20) != []


def test_settled_deletes_what_was_staged_on_the_way(spark):
    from gossamer.llm import common

    before, seen = len(common._STAGED.folders), []

    def make():
        frame = common.stage(spark.range(5))
        seen.extend(frame.inputFiles())
        return frame.where("id > 1")

    assert common.settled(make).count() == 3 and len(common._STAGED.folders) == before
    assert seen and not any(os.path.exists(f.removeprefix("file://")) for f in seen)


def test_jaccard_counts_a_repeated_row_once(spark):
    words = words_of(120, 5)
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (1, " ".join(words)), (1, " ".join(words)), (2, near), *[(None, "the same text of some words here")] * 40]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == (1, 1, 3) and got[2] == (1, 1, 1) and got[None] == (None, 0, 40)


def test_line_dedup_finds_short_passages_wherever_they_are(spark):
    """Planted passages of 2 to 6 lines and over 50 words, between lines that no other text has."""
    rng, rows, planted = random.Random(8), [], {}
    for k in range(60):
        n = 2 + k % 5
        sizes = [52 // n + 1 + rng.randrange(2) for _ in range(n)]
        passage = [" ".join(f"p{k}x{j}x{i}" for i in range(size)) for j, size in enumerate(sizes)]
        for copy in range(3):
            own = [" ".join(f"o{k}x{copy}x{j}x{i}" for i in range(5 + rng.randrange(12))) for j in range(10)]
            at = rng.randrange(1, 9)
            planted[3 * k + copy] = (passage, own)
            rows.append((3 * k + copy, "\n".join([*own[:at], *passage, *own[at:]])))
    got = {r.doc_id: r.text for r in lines.remove(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(len(" ".join(p).split()) > 50 for p, _ in planted.values())
    assert {d: t for d, t in got.items() if d % 3 == 0} == {d: t for d, t in rows if d % 3 == 0}
    assert all(got[d] == "\n".join(own) for d, (_, own) in planted.items() if d % 3)


def test_line_dedup_keeps_one_whole_place_of_overlapping_repeats(spark):
    line = " ".join(f"again{i}" for i in range(15))
    found = {r.doc_id: r.text for r in lines.remove(spark.createDataFrame([(1, "\n".join([line] * 9))], DOCS)).collect()}
    assert found[1].split("\n")[:2] == [line] * 2


def test_chunks_do_not_shift():
    body = [" ".join(words_of(6, k)) for k in range(200)]
    whole = {h for _, _, h in lines.chunks("\n".join(body))}
    moved = {h for _, _, h in lines.chunks("\n".join(["new", *body[:100], "also new", *body[100:]]))}
    assert len(whole - moved) <= 4 and len(whole) > 30


def scored_by_hand(rows, order):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row, counted with dictionaries."""
    lm = language_model
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")), None]
    texts = [split(t) for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    grams = Counter()
    for ws, h in zip(texts, held):
        for n in range(1, 4):
            padded = ["<b>"] * (n - 1) + ws
            grams.update(() if h else (tuple(padded[i : i + n]) for i in range(len(ws))))
    starts = len(held) - sum(held)
    grams["<b>",] = grams["<b>", "<b>"] = starts
    n = sum(c for g, c in grams.items() if len(g) == 1) - starts
    total = n + 0.1 * (sum(len(g) == 1 for g in grams if grams[g]) - (starts > 0) + 1)

    def places(ws):
        padded = ["<b>", "<b>", *ws]
        for i in range(len(ws)):
            u, v, w = padded[i : i + 3]
            c = [grams[x] for x in ((w,), (v,), (v, w), (u, v), (u, v, w))]
            yield c, int(lm.bucket(np.array(c[1]), 1) + (lm.BUCKETS[0] * lm.bucket(np.array(c[3]), 2) if order == 3 else 0))

    cells = Counter()
    for ws, h in zip(texts, held):
        for c, b in () if h else places(ws):
            two, three = ((c[k + 1] - 1) / (c[k] - 1) / (c[0] + 0.1) if c[k] > 1 else 0.0 for k in (1, 3))
            cells[(b * lm.BINS + int(lm.bin_of(np.array(three))) if order == 3 else b) * lm.BINS + int(lm.bin_of(np.array(two)))] += 1
    mix = lm.weights(np.array(list(cells), np.int64), np.array(list(cells.values()), float), total, order)
    for (d, _), ws, h in zip(rows, texts, held):
        base = score = 0.0
        for c, b in places(ws):
            p1 = (c[0] + 0.1) / total
            base += math.log10(p1)
            longest = mix[b, 2] * c[4] / max(c[3], 1) if order == 3 else 0.0
            score += math.log10(mix[b, 0] * p1 + mix[b, 1] * c[2] / max(c[1], 1) + longest)
        yield d, h, len(ws), sum(grams[w,] > 0 for w in ws), n, base, score


def same_scores(docs, rows, order=2):
    got = sorted((tuple(r) for r in language_model.score(docs, order).collect()), key=str)
    want = sorted(scored_by_hand(rows, order), key=lambda r: str(r[:5]))
    assert Counter(r[:5] for r in got) == Counter(r[:5] for r in want)
    near = lambda rs: sorted((str(r[:5]), round(r[5], 3), r[6]) for r in rs)
    for a, b in zip(near(got), near(want), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 0.01 and abs(a[2] - b[2]) < 1e-4 * (1 + abs(b[2]))


def test_language_model_equals_counting_by_hand(docs, monkeypatch):
    same_scores(docs, corpus())
    same_scores(docs, corpus(), 3)
    # many small batches and slots
    monkeypatch.setattr(language_model, "BATCH_BYTES", 2000)
    monkeypatch.setattr(language_model, "SLOT_BYTES", 500)
    same_scores(docs.repartition(7), corpus())


def test_language_model_gains_from_contexts(spark):
    rng = random.Random(2)
    pairs = {f"v{i}": f"v{(7 * i + 3) % 50}" for i in range(50)}
    rows = []
    for d in range(400):
        w, out = f"v{rng.randrange(50)}", []
        for _ in range(40):
            out.append(w)
            w = pairs[w] if rng.random() < 0.8 else f"v{rng.randrange(50)}"
        rows.append((d, " ".join(out)))
    got = [r for r in language_model.score(spark.createDataFrame(rows, DOCS)).collect() if r.held_out]
    assert got and all(r.score > 0.6 * r.base_score for r in got)
    assert language_model.score(spark.createDataFrame([], DOCS)).count() == 0
    only = language_model.score(spark.createDataFrame([(d, "a b") for d in range(40) if zlib.crc32(str(d).encode()) % 10 == 0], DOCS)).collect()
    assert only and all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score - r.base_score) < 1e-6 for r in only)


def test_language_model_codes_and_weights():
    lm = language_model
    counts = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert (lm._counts(lm._small(counts), 6) == counts).all()
    for kind, slots in ((0, 1), (0, 100), (1, 64), (2, 77_777)):
        deal, hashes = lm.Deal.of(kind, slots), np.random.default_rng(4).integers(0, 1 << 64, 5000, dtype=np.uint64)
        order, ends, keys = deal.sorted(hashes)
        for k in np.flatnonzero(np.diff(ends))[:500].tolist():
            some = slice(ends[k], ends[k + 1])
            back, n = deal.decoded(k, deal.coded(k, keys[some], np.arange(5000)[some]))
            assert (back == keys[some]).all() and (n == np.arange(5000)[some]).all()
        assert (hashes[order] >> np.uint64(deal.shift) == keys).all() and ends[-1] == 5000
    assert lm.bucket(np.array([0, 1, 2, 3, 4, 7, 8, 1 << 60]), 2).tolist() == [0, 1, 2, 3, 4, 4, 5, 9]
    cells = np.array([(5 + 16 * 3) * lm.BINS**2, ((5 + 16 * 3) * lm.BINS + 60 - 10) * lm.BINS])
    mix = lm.weights(cells, np.array([20.0, 80.0]), 1e3, 3)
    assert np.isclose(mix.sum(1), 1).all() and 0.6 < mix[5 + 16 * 3, 2] < 0.9 and mix[0].tolist() == [1, 0, 0]


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (12, 16))
    x = (centres[rng.integers(12, size=3000)] + rng.normal(0, 0.3, (3000, 16))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(4000, None), (4020, [0.0] * 16), (4001, [float("nan")] * 16), (4002, [None] * 16), (4003, [1.0]), (None, [1.0] * 16), (4004, [])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.report(frame).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    d = x.astype(np.float64)
    for q in range(0, 3000, 20):
        s = (d * d[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(s[m[1]] - m[2]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & set(best))
    assert hits / (20 * 150) >= 0.9 and set(got) == set(range(0, 3000, 20))
    few = neighbours.report(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>"))
    assert few.count() == 4
    assert neighbours.report(frame.limit(0)).count() == 0


def recall_of(frame, x, ids, got):
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(1)
        true = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:20]
        hits += len({int(ids[i]) for i in true} & got[int(ids[q])])
        total += len(true)
    return hits / total


def test_neighbours_recall_on_the_given_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = defaultdict(set)
    for r in neighbours.report(frame).collect():
        got[r.query_id].add(r.vec_id)
    rows = frame.toPandas()
    assert recall_of(frame, np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy(), got) >= 0.9


def test_neighbours_with_subtrees_and_copied_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (20, 12))[rng.integers(20, size=4000)] + rng.normal(0, 0.4, (4000, 12))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    tree, n = neighbours.fit(frame.where("vec_id < 200"))
    more = neighbours.refined(frame, tree, most=100, sub_sample=100)
    assert more.leaves > 2 * tree.leaves and n == 200
    leaves = more.leaf_of(x)
    assert leaves.max() < more.leaves and (more.number[[0]] > 0).all() and len(np.unique(leaves)) > tree.leaves
    assert sorted(more.listed().best_bins(more.promise(x[:1]).tolist()[0], more.leaves)) == list(range(more.leaves))
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    got = defaultdict(set)
    for r in neighbours.search(frame, frame.where("vec_id % 20 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    assert recall_of(frame, x, np.arange(4000), got) >= 0.9 and all(len(g) == 20 for g in got.values())


def test_pipeline_stages(spark, tmp_path):
    rows = [(d, t, "en", "s", 0, "own") for d, t in corpus() if d is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[30][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = step(spark, at, str(tmp_path))
        assert now.columns == docs.columns
        at = now
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "ids", "decoded"} <= set(out.columns)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 30 not in ids and 31 in ids and not {75, 76, 77, 78, 79} & set(ids)
    # text that is nowhere else stays, however much of its document is repeated
    shared = [" ".join(words_of(12, 7000 + k)) for k in range(40)]
    own = {i: " ".join(words_of(100, 8000 + i)) for i in range(1, 6)}
    template = spark.createDataFrame([(i, "\n".join([*shared[:20], own[i], *shared[20:]])) for i in own] + [(9, "\n".join(shared))], DOCS)
    left = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, template, "").collect()}
    assert set(left) == set(own) and all(own[i] in left[i] for i in own) and sum(len(t) for t in left.values()) < 2 * len("\n".join(shared)) + 5 * 1200


def test_pipeline_of_odd_tables(spark, tmp_path):
    rows = [(None, None, 1), (None, "no id here", 2), (3, "", 3), (3, "", 3), (4, None, 4), (5, "word " * 60_000 + "z" * 200_000, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, cls int").selectExpr("*", "1 AS _id", "2 AS lines_kept", "'x' AS ids").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter((r.doc_id, None if r.text is None else len(r.text)) for r in out)
    assert got == Counter([(3, 0), (4, None), (5, 500_000), (None, 10), (None, None)]) and {(r.cls == (r.doc_id or r.cls), r.lines_kept) for r in out} == {(True, 2)} and {r["_id"] for r in out} == {1}
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, str(tmp_path)).count() == 0
