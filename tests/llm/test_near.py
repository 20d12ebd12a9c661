"""Similarity join, fingerprints, vector search, pipeline: brute force on small tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from loomspark.llm import anisotropic, chosen_path, common, edit_print
from loomspark.llm.components import components

DOCS = "doc_id long, text string"


def brute_links(rows):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in near[i]:
                label[i] = label[j] = min(label[i], label[j])
    groups = defaultdict(list)
    for i in range(n):
        groups[label[i]].append(rows[i][0])
    low = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], low[label[i]], len(near[i])) for i in range(n)), key=str)


def corpus(seed=5, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, shared = [], [word() for _ in range(60)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
        rows.append(" ".join(base + shared))
    chain = [word() for _ in range(120)]
    for i in range(40):  # many near copies of one text
        chain = list(chain)
        chain[rng.randrange(120)] = word()
        rows.append(" ".join(chain))
    rows += ["", None, "   ", "one", "one", "One  two", "x y z w v", rows[0], rows[0]]
    out = list(enumerate(rows))
    out[3] = (None, out[3][1])
    return [*out, out[5], (out[6][0], "another text with the same id as some other document here")]


@pytest.mark.parametrize("limits", [(50_000, 2_000_000), (6, 300)])
def test_join_equals_brute_force(spark, limits):
    rows = corpus()
    table = spark.createDataFrame(rows, DOCS).selectExpr("*", "'c' AS cls", "'k' AS key", "1 AS n_links")
    got = sorted((tuple(r) for r in chosen_path.links(table, task_bucket=limits[0], task_shingles=limits[1]).collect()), key=str)
    assert got == brute_links(rows)


@pytest.mark.parametrize("tile", [3, 1024])
def test_tiles_equal_brute_force(tile, monkeypatch):
    monkeypatch.setattr(chosen_path, "TILE", tile)
    rng = np.random.default_rng(11)
    base = rng.choice(10_000, 60, replace=False)
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(60, rng.integers(0, 9), replace=False)), rng.choice(10_000, 4)])).astype(np.uint64) for _ in range(90)]
    copies = rng.integers(1, 4, 90)
    true = [{j for j in range(90) if j != i and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))} for i in range(90)]
    counts, top = np.zeros(90, np.int64), np.arange(90)
    for i in range(90):
        for j in true[i]:
            top[top == max(top[i], top[j])] = min(top[i], top[j])
        counts[i] = sum(copies[j] for j in true[i])
    whole, half = np.arange(90), (np.arange(0, 90, 2), np.arange(1, 90, 2))
    got = chosen_path.compare_sets(sets, copies, [(whole, whole)], 0.8)
    assert 0 < sum(map(len, true)) < 90 * 89 and np.array_equal(got[0], counts) and np.array_equal(got[1], top)
    got = chosen_path.compare_sets(sets, copies, [half, (half[0], half[0]), (half[1], half[1])], 0.8)
    assert np.array_equal(got[0], counts) and np.array_equal(got[1], top)


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert chosen_path.links(empty).count() == 0 and chosen_path.keep_firsts(empty).count() == 0


def test_keep_firsts_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words stand here now"), (None, "other words stand here now"), (4, None), (None, None), (5, "q r"), (5, "q r")]
    kept = chosen_path.keep_firsts(spark.createDataFrame(rows, DOCS).selectExpr("*", "7 AS cls"))
    assert kept.columns == ["doc_id", "text", "cls"]
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([(1, rows[0][1]), (3, rows[3][1]), (4, None), (None, None), (5, "q r")], key=str)


def test_keep_firsts_with_clashing_columns_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text + " more"), (2, text), (9, "alone here")]
    names = ("_text", "_first", "_print", "_id", "_text_hash", "print", "lead", "cls", "i", "block", "members", "TEXT_")
    kept = chosen_path.keep_firsts(spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"'x{i}' AS `{c}`" for i, c in enumerate(names)]))
    assert kept.columns == ["doc_id", "text", *names]
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == [1, 9] and all(r[c] == f"x{i}" for r in got for i, c in enumerate(names))


def test_pairs_are_found_in_large_buckets_and_at_depth():
    """Sketches that share a template at every split: buckets far above a leaf, planted pairs agree at 4 of 5 positions."""
    rng, pairs = np.random.default_rng(8), 300
    rows = rng.integers(0, 3, (2 * pairs, chosen_path.WIDTH)).astype(np.uint16)
    rows[rng.random(rows.shape) < 0.55] = 0  # a common value: one bucket takes most of all rows at every position
    for k in range(pairs):
        rows[2 * k + 1] = rows[2 * k]
        at = rng.choice(chosen_path.WIDTH, round(0.2 * chosen_path.WIDTH), replace=False)
        rows[2 * k + 1, at] = 900 + rng.integers(0, 60_000, len(at))
    least = int(0.79 * chosen_path.WIDTH)
    assert not np.triu(chosen_path._near(rows[::2], rows[::2], least), 1).any()
    root = np.arange(len(rows))
    sizes = []
    for run in range(chosen_path.runs(0.8, 0.998)):
        path = int(chosen_path._mix(run, 99)[0])
        p = chosen_path.positions(path, 1)[0]
        for value in np.unique(rows[:, p]):
            at = np.flatnonzero(rows[:, p] == value)
            sizes.append(len(at))
            if len(at) > 1:
                chosen_path.descend(rows, at, int(chosen_path.child(path, p, rows[at[:1], p])[0]), least, root)
    found = sum(chosen_path._find(root, 2 * k) == chosen_path._find(root, 2 * k + 1) for k in range(pairs))
    assert max(sizes) > 3 * chosen_path.LEAF and found / pairs >= 0.99


def test_grid_meets_every_pair(spark):
    rows = spark.range(300).selectExpr("cast(id as string) cls", "cast(id % 3 as long) path", "100L members")
    cells = common.grid(rows, "cls", least=20).collect()
    met = {}
    for r in cells:
        met.setdefault((r.path, r.i, r.j), set()).add(int(r.cls))
    pairs = {(a, b) for own in met.values() for a in own for b in own if a < b}
    assert pairs == {(a, b) for a in range(300) for b in range(a + 1, 300) if a % 3 == b % 3}
    assert max(map(len, met.values())) < 80 and {r.i for r in common.grid(rows, "cls", least=200).collect()} == {0}


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "c"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {r.node: r.label for r in components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}


def test_walk_is_a_shared_edit_embedding():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    own = edit_print.classes_of(text)
    states, step = [], 0
    for c in own:  # step by step: write the character until its coin says move on
        while not edit_print._COINS[c, step % edit_print.PERIOD]:
            step += 1
        step += 1
        states.append(step % edit_print.PERIOD)
    assert edit_print.walk(own).tolist() == states
    other = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    few = text[:1000] + "x" + text[1001:2000] + text[2001:]
    near, far = edit_print.likeness(edit_print.of(text), edit_print.of(few)), edit_print.likeness(edit_print.of(text), edit_print.of(other))
    assert near > 0.8 and far < 0.1 and edit_print.likeness(edit_print.of(text), edit_print.of(text)) == 1


def test_edited_fingerprints_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcde é日") for _ in range(rng.randint(0, 90)))) for i in range(40)] + [(None, None), (50, ""), (51, "z" * 9000)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, DOCS).selectExpr("*", "'p' AS part", "1 AS edge")
    order = [(d, t or "") for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    expected = []
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        a, b = edit_print.of(t), edit_print.of(edited)
        expected.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, edit_print.likeness(a, b), edit_print.likeness(a, edit_print.of(nxt))))
    assert sorted((tuple(r)[:7] for r in edit_print.edited_fingerprints(table).collect()), key=str) == sorted(expected, key=str)
    for r in edit_print.edited_fingerprints(table).collect():
        bands = lambda p: {(i, p[i : i + 8]) for i in range(0, 256, 8)}
        assert r.candidate_edited == bool(bands(r.fingerprint) & bands(r.edited_fingerprint)) and r.verified_edited == (r.candidate_edited and r.near_edited >= 0.5)
    one = edit_print.edited_fingerprints(spark.createDataFrame([(1, "abcdefgh")], DOCS)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    assert edit_print.edited_fingerprints(table.where("false")).count() == 0


def test_near_classes(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    rows = [(1, text), (2, text), (3, text[:2000] + "q" + text[2001:]), (4, text[::-1]), (5, None)]
    assert {r.doc_id: r.class_id for r in edit_print.near_classes(spark.createDataFrame(rows, DOCS)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_banding_finds_texts_of_few_edits_in_hot_bands(spark):
    rng = random.Random(9)
    head = "".join(rng.choice("abcdefghij ") for _ in range(40))  # one beginning for all: hot bands
    rows, truth = [], []
    for i in range(60):
        own = head + "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(800, 1600)))
        rows.append((2 * i, own))
        at = sorted(rng.sample(range(50, len(own)), 3))
        rows.append((2 * i + 1, own[: at[0]] + "x" + own[at[0] + 1 : at[1]] + own[at[1] + 1 : at[2]] + "yz" + own[at[2] :]))
        truth.append((2 * i, 2 * i + 1))
    near = [p for p in truth if edit_print.likeness(edit_print.of(rows[p[0]][1]), edit_print.of(rows[p[1]][1])) >= 0.8]
    found = {r.doc_id: r.class_id for r in edit_print.near_classes(spark.createDataFrame([*rows, (500, "x" * 60_000)], DOCS), cell=8).collect()}
    assert len(near) > 40 and sum(found[a] == found[b] for a, b in near) == len(near)
    assert len(set(found.values())) >= 60 and edit_print.near_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_coarse_cells_keep_their_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in anisotropic.search(table, every=100, lists=16, probes=5).collect():
        found[r.query_id].add(r.vec_id)
    hits = [len(found[q] & set(np.argsort(-np.where(np.arange(3000) == q, -np.inf, x @ x[q]), kind="stable")[:20].tolist())) for q in range(0, 3000, 100)]
    assert sum(hits) / (20 * len(hits)) >= 0.9


def vectors(n=900, dim=10, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x[100:400] = x[99]  # a third of all rows are one vector
    return x


def test_search_recall_and_exact_scores(spark):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 10), (1040, [float("nan")] * 10), (1060, [1.0] * 9), (None, [1.0] * 10), rows[5]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS item", "'v' AS v")
    found = defaultdict(list)
    for r in anisotropic.search(table, depth=60).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits, x64 = 0, x.astype(np.float64)
    assert sorted(found) == list(range(0, 900, 20))
    for q, own in found.items():
        own.sort()
        s = x64 @ x64[q]
        best = [i for i in sorted(range(900), key=lambda i: (-round(s[i], 9), i)) if i != q][:20]
        assert [o[0] for o in own] == list(range(1, 21)) and q not in [o[1] for o in own]
        assert np.allclose([o[2] for o in own], s[[o[1] for o in own]])
        hits += len({o[1] for o in own} & set(best))
    assert hits / (20 * len(found)) >= 0.9


def test_search_inside_tight_clusters(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 16))[rng.integers(0, 4, 4000)] + 0.01 * rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1] = x[0]
    found = defaultdict(list)
    for r in anisotropic.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=200).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    for q in range(0, 4000, 200):
        s = x @ x[q]
        assert [i for _, i in sorted(found[q])] == [i for i in sorted(range(4000), key=lambda i: (-round(s[i], 13), i)) if i != q][:20]


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.9])
def test_scan_is_exact_at_any_depth(threshold):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 10)) * rng.uniform(0.01, 3, (1500, 1)) + rng.normal(size=10) * 0.3
    book = anisotropic.fit(x, threshold)
    packed = anisotropic.pack_codes(book.assign(book.pad(x)))
    queries = np.concatenate([x[:30], -x[:10], np.zeros((1, 10)), rng.normal(size=(9, 10)) * 100])
    for k, depth in ((5, 5), (20, 60), (1400, 1450)):
        rows, scores = anisotropic.scan(book, packed, x, queries, k, depth)
        true = np.sort(x @ queries.T, axis=0)[::-1][:k].T
        assert np.allclose(scores, true, atol=1e-12) and all(len(set(r)) == k for r in rows.tolist())


def test_search_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in anisotropic.search(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert anisotropic.search(few.where("false")).count() == 0 and anisotropic.search(few.where("vec_id = 1")).count() == 0


def test_anisotropic_loss_cuts_the_parallel_error():
    x = np.random.default_rng(1).normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parallel = []
    for threshold in (0.0, 0.4):
        book = anisotropic.fit(x, threshold)
        codes = book.assign(x)
        near = book.centres[np.arange(codes.shape[1])[None], codes].reshape(len(x), -1)
        parallel.append((((x - near) * x).sum(1) ** 2).mean())
    assert parallel[1] < parallel[0]


def test_pipeline_stages(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = corpus_pipeline.known_language(spark, docs, data)
    assert first.schema == docs.schema
    groups = {r.doc_id: r.class_id for r in chosen_path.links(docs).collect()}
    kept = [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, data).collect()]
    assert sorted(kept) == sorted(set(groups.values()))
    out = corpus_pipeline.run(spark, data)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, _text string, _first string, cls string, print string, length string"


def test_pipeline_stages_on_odd_tables(spark):
    data = "/root/testdata/sf0.001"
    fine = "The river runs past the old mill and the people of the town walk along it every morning. " * 4
    rows = [(1, None, "en"), (2, "", None), (None, fine, "en"), (4, fine, "en"), (4, fine, "en"), (5, "x " * 60_000, "en"), (6, "½ ²", None)]
    table = spark.createDataFrame([(d, t, lang, "s", 1, "a", "b", "c", "d", "e") for d, t, lang in rows], ODD)
    for docs in (table, table.where("false")):
        for stage in (corpus_pipeline.known_language, corpus_pipeline.usable, corpus_pipeline.one_of_each_group):
            out = stage(spark, docs, data)
            assert out.columns == docs.columns
            if docs is not table:
                assert out.count() == 0
        assert corpus_pipeline.packed(spark, docs, data).count() >= (docs is table)
    kept = corpus_pipeline.one_of_each_group(spark, table, data).collect()
    assert sorted((str(r.doc_id) for r in kept)) == ["1", "2", "4", "5", "6"] and all(r._text == "a" and r.length == "e" for r in kept)
