"""The training-data operators against brute force, round trips and held-out accuracy, with odd inputs."""

import base64
import collections
import hashlib
import itertools
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tabulane.llm import byte_bpe, chat, components, fingerprint, jaccard_join, kmeans_tree, language, mixing, quality, suffix_dedup, token_counts
from tabulane.llm.common import RangeHash, read_ranks
from tabulane.llm.components import connected_components

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(VOCABULARY)
LONG = " ".join(f"word{i * 7919 % 1000}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, "alpha beta gamma delta epsilon zeta eta theta"),
    (3, "ALPHA  beta gamma\ndelta epsilon zeta eta theta iota"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "one two"),
    (8, "One\ttwo"),
    (9, PASSAGE + " own words of nine"),
    (10, "other words first " + PASSAGE),
    (11, LONG),
    (12, "é" * 150 + " ü"),
    (13, "x" + "é" * 150),
    (14, "12 34 !!"),
    (14, "the same id again with another text"),
    (14, "the same id again with another text"),
    (None, "a row without an id"),
]
SCHEMA = "doc_id long, text string, score string, n_tokens string, lower string, id string, part string"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", "n", "l", "x", "p") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_key(values):
    return sorted(values, key=repr)


# 1 language


def test_language_held_out(spark, data):
    from tabulane.llm.queries import op1_language

    found = op1_language(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    good = [r["lang"] == r["lang_pred"] for r in found.collect() if r["held_out"]]
    assert len(good) > 20 and np.mean(good) > 0.95


def test_language_odd_rows(spark, docs, empty):
    learn = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    profiles = language.learn_profiles(learn)
    assert profiles.langs == ["de", "en"]
    found = {(r["doc_id"], r["lang_pred"], r["score"] == 0) for r in language.detect_language(docs, profiles).collect()}
    assert {(4, "und", True), (5, "und", True), (6, "und", True)} <= found
    assert language.detect_language(docs, profiles).count() == len(TEXTS)
    assert rows(language.detect_language(empty, profiles)) == []
    assert language.classify("the dog", language.learn_profiles(learn.limit(0))) == ("und", 0.0)


def test_language_distance_by_hand():
    text = "ab ab c"
    grams, counts = language._counted(language._grams(language._symbols(text)))
    own = language._top(grams, counts, 5)
    profiles = language.Profiles(["x", "y"], np.sort(own[:3]), np.full((3, 2), 5), 5)
    for place, gram in enumerate(own[:3]):
        profiles.ranks[np.searchsorted(profiles.grams, gram), 1] = place
    assert language.classify(text, profiles) == ("y", pytest.approx(1 - 10 / 25))


def brute_grams(text):
    """Counts of the 1- to 3-grams of a text, as tuples: 1 stands for anything between words, letters for their number plus 2."""
    marks = [1]
    for c in text.lower() + " ":
        if c.isalpha():
            marks.append(ord(c) + 2)
        elif marks[-1] != 1:
            marks.append(1)
    found = collections.Counter((m,) for m in marks if m != 1)
    found.update(zip(marks, marks[1:]))
    found.update(t for t in zip(marks, marks[1:], marks[2:]) if t[1] != 1)
    return found


def brute_profile(counts, size):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size])}


def test_language_against_plain_dicts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    learned = language.learn_profiles(docs.filter("doc_id % 4 != 2"))
    made = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    counts = collections.defaultdict(collections.Counter)
    for i, text, lang in made:
        if i % 4 != 2 and text is not None and lang is not None:
            counts[lang].update(brute_grams(text))
    profiles = {lang: brute_profile(c, language.PROFILE) for lang, c in sorted(counts.items())}
    assert learned.langs == list(profiles)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.detect_language(docs, learned).collect()}
    assert len(got) == len(made)
    for i, text, _ in made:
        own = brute_profile(brute_grams(text or ""), language.PROFILE)
        if not any(c.isalpha() for c in text or ""):
            assert got[i] == ("und", 0.0)
            continue
        apart = {lang: sum(abs(p[g] - n) if g in p else language.PROFILE for g, n in own.items()) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        assert got[i] == (best, pytest.approx(1 - apart[best] / (language.PROFILE * len(own))))


# 2 mixing


def test_mixing_weights(spark):
    table = spark.createDataFrame([("+a", "a", 900), ("+b", "b", 90), ("+c", "c", 10), ("-", None, 0)], "source_key string, source string, tokens long")
    mix = mixing.solve(table, entropy=0.5)
    weights = {r["source"]: r["weight"] for r in mix.sources.collect()}
    shares = np.array([0.9, 0.09, 0.01])
    h = lambda w: -(w * np.log(w)).sum()
    assert h(np.array([weights[k] for k in "abc"])) == pytest.approx((h(shares) + np.log(3)) / 2, abs=1e-8)
    assert set(weights) == {"a", "b", "c"}
    limited = mixing.solve(table, entropy=None, max_repeats=2.0)
    assert max(r["weight"] * 1000 / r["tokens"] for r in limited.sources.collect()) == pytest.approx(2.0, abs=1e-6)
    assert mixing.solve(table.limit(0)).sources.count() == 0


def test_mixing_budget_is_exact(spark):
    made = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 3 else None) for i in range(3000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    found = mixing.mix_sources(docs, entropy=0.9, max_repeats=None).collect()
    total = {s: sum(len(t.split()) for _, t, x in made if x == s) for s in ("big", None)}
    used = {s: sum(r["n_tokens"] for r in found if r["source"] == s) for s in ("big", None)}
    assert sum(total.values()) - 14 <= sum(used.values()) <= sum(total.values())
    passes = {}
    for r in found:
        passes.setdefault((r["source"], r["pass"]), []).append(r["doc_id"])
    for (source, number), ids in passes.items():
        assert len(ids) == len(set(ids))  # a permutation, whole but for the last pass
        if (source, number + 1) in passes:
            assert len(ids) == sum(x == source for *_, x in made)


def test_mixing_odd_rows(spark, docs, empty):
    tagged = docs.withColumn("source", F.lit("s"))
    assert mixing.mix_sources(tagged).count() > 0
    assert mixing.mix_sources(empty.withColumn("source", F.lit("s"))).count() == 0


# 3 neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) + 4 * rng.normal(size=(20, 16)).repeat(150, axis=0)
    x[500:900] = x[0]  # a large group of equal vectors
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (None, [1.0] * 16), (9005, [1.0])]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    found = kmeans_tree.nearest_neighbours(table, F.pmod("vec_id", F.lit(20)) == 0).collect()
    lists = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        lists.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(lists) == set(range(0, 3000, 20)) and all(len(v) == 20 for v in lists.values())
    hits = 0
    for q, got in lists.items():
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -score))[:20]
        hits += len(set(best) & {i for i, _ in got})
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        assert all(s == pytest.approx(x[i] @ x[q]) for i, s in got)
        assert all(a[0] < b[0] for a, b in zip(got, got[1:]) if a[1] == b[1])
    assert hits / (20 * len(lists)) >= 0.9


def test_neighbours_small_tables(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    found = kmeans_tree.nearest_neighbours(table, F.pmod("vec_id", F.lit(20)) == 0)
    assert rows(found.orderBy("rank")) == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]
    assert rows(kmeans_tree.nearest_neighbours(table.limit(0), F.lit(True))) == []


def test_neighbours_repeated_ids_and_clashing_names(spark):
    made = [(0, [1.0, 0.0]), (0, [3.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 9.0])]
    table = spark.createDataFrame([(i, v, *"abcdef") for i, v in made], "vec_id long, embedding array<double>, leaf string, v string, q string, id string, score string, rank string")
    found = kmeans_tree.nearest_neighbours(table, F.col("vec_id") % 20 == 0, k=2)
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()  # cut to k in every task, before the shuffle
    # both rows of id 0 ask; neither is found by the other; what they find is ranked together
    assert sorted(rows(found)) == [(0, 1, 1, 3.0), (0, 2, 1, 3.0)]


# 4 suffix sorting


def brute_spans(documents):
    """Removed bytes of (doc_id, text) by looking at every window."""
    seen, removed = {}, {}
    for key, data in sorted(documents):
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                gone[p : p + 100] = True
            else:
                seen[window] = key
        removed[key] = gone
    return removed


def test_suffix_dedup_brute_force(spark):
    rng = np.random.default_rng(3)
    block = [bytes(rng.integers(97, 101, 400).astype(np.uint8)) for _ in range(6)]
    made = []
    for i in range(60):
        parts = [block[j][: rng.integers(50, 400)] for j in rng.integers(0, 6, 3)]
        made.append((i, b" ".join(parts) + bytes(rng.integers(97, 123, 60).astype(np.uint8))))
    made += [(60, b"a" * 350), (61, b"ab" * 200), (62, made[0][1]), (63, b""), (64, b"z" * 99)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in made], "doc_id long, text string").repartition(4)
    removed = brute_spans(made)
    for r in suffix_dedup.repeat_digests(docs).collect():
        gone, data = removed[r["doc_id"]], dict(made)[r["doc_id"]]
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1))
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), r["doc_id"]


def test_suffix_dedup_very_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 2)
    rng = np.random.default_rng(4)
    shared = bytes(rng.integers(97, 123, 130).astype(np.uint8))
    made = [(i, bytes(rng.integers(97, 123, 80).astype(np.uint8)) + shared + bytes(rng.integers(97, 123, 80).astype(np.uint8))) for i in range(40)]
    removed = brute_spans(made)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in made], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeat_digests(docs).collect()} == {k: int(v.sum()) for k, v in removed.items()}


def test_deep_shallow_order():
    rng = np.random.default_rng(9)
    data = np.concatenate([np.tile(rng.integers(97, 99, 70), 8), rng.integers(97, 99, 300)]).astype(np.uint8)
    at = rng.permutation(len(data) - 100)
    group = at % 3
    order, new = suffix_dedup.sort_windows(data, at, group)
    key = [(int(group[i]), data[at[i] : at[i] + 100].tobytes()) for i in order]
    assert key == sorted(key)
    assert new.tolist() == [True] + [a != b for a, b in zip(key, key[1:])]


def test_suffix_dedup_odd_rows(spark, docs, empty):
    found = by_key(rows(suffix_dedup.repeat_digests(docs)))
    assert len(found) == len(TEXTS)
    nothing = hashlib.sha256(b"").hexdigest()
    assert (4, 0, 0, 0, nothing) in found and (5, 0, 0, 0, nothing) in found
    assert next(r for r in found if r[0] == 10)[2] > 400
    assert rows(suffix_dedup.repeat_digests(empty)) == []
    text = "0123456789" * 30
    twice = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    counts = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.repeat_digests(twice).collect()}
    assert counts == {(1, 290), (2, 300), (None, 300)}
    kept = suffix_dedup.strip_repeats(spark.createDataFrame([(1, "x" + "é" * 150), (2, "é" * 149 + "yy")], "doc_id long, text string"))
    assert dict(rows(kept))[2].endswith("yy")


# 5 token counts


def greedy(word, vocabulary):
    n, at = 0, 0
    while at < len(word):
        at += max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in vocabulary), default=1)
        n += 1
    return n


def test_piece_counter_is_greedy():
    rng = np.random.default_rng(1)
    for _ in range(200):
        vocabulary = {bytes(rng.integers(97, 100, rng.integers(1, 6)).astype(np.uint8)) for _ in range(rng.integers(1, 25))}
        counter = token_counts.PieceCounter(vocabulary)
        word = bytes(rng.integers(97, 101, 40).astype(np.uint8))
        assert counter.count(word) == greedy(word, vocabulary)


def test_token_counts_odd_rows(docs, empty):
    found = by_key(rows(token_counts.count_tokens(docs, VOCABULARY)))
    expected = [(i, len((t or "").encode().split()), sum(greedy(b" " + w, RANKS) for w in (t or "").encode().split())) for i, t in TEXTS]
    assert found == by_key(expected)
    assert rows(token_counts.count_tokens(empty, VOCABULARY)) == []


# 6 quality


def test_quality_held_out(spark, data):
    from tabulane.llm.queries import op6_quality

    labels = spark.read.parquet(f"{data.replace('0.001', '0.01')}/labels.parquet")
    found = op6_quality(spark, data.replace("0.001", "0.01")).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found if r["held_out"]]) > 0.95


def test_quality_density_by_hand():
    rng = np.random.default_rng(2)
    mean, spread = rng.normal(size=3), np.diag([1.0, 2.0, 3.0]) + 0.3
    model = quality.Discriminant(
        [mean, mean + 1], [np.linalg.inv(np.linalg.cholesky(spread))] * 2, [float(np.linalg.slogdet(spread)[1])] * 2, 0.2, 0.0
    )
    x = rng.normal(size=(5, 3))
    far = [np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(spread), x - m) for m in model.means]
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(-(0.5 * (far[0] - far[1]) + 0.2))))


def test_quality_odd_rows(spark, docs, empty):
    stats = quality.document_statistics(docs)
    labels = spark.createDataFrame([(1, 1), (7, 0), (9, 1), (14, 0), (14, 1), (11, None), (None, 1)], "doc_id long, quality int")
    for own in (labels, labels.filter("quality = 1"), labels.limit(0)):
        model = quality.learn_quality(stats, own, F.lit(True))
        scores = [r["score"] for r in quality.score_statistics(stats, model).collect()]
        assert len(scores) == len(TEXTS) and all(0 <= s <= 1 for s in scores)
    assert scores == [1.0] * len(TEXTS)
    assert quality.document_statistics(empty).count() == 0


def test_quality_fit_against_numpy(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn_quality(quality.document_statistics(docs), labels, F.col("doc_id") % 4 != 2)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    made = {r["doc_id"]: quality.statistics(r["text"]) for r in docs.collect()}
    own = [np.array([x for i, x in made.items() if i % 4 != 2 and marks.get(i) == c]) for c in (0, 1)]
    spreads = [np.cov(x.T, bias=True) for x in own]
    common = sum(s * len(x) for s, x in zip(spreads, own)) / sum(map(len, own))
    density = []
    every = np.array(list(made.values()))
    for x, s, mean, whiten, log_det in zip(own, spreads, model.means, model.whiten, model.log_det):
        shrunk = (1 - quality.POOLED) * s + quality.POOLED * common
        p = len(shrunk)
        shrunk = (1 - quality.DIAGONAL) * shrunk + (quality.DIAGONAL * np.trace(shrunk) / p + 1e-9) * np.eye(p)
        assert mean == pytest.approx(x.mean(axis=0), rel=1e-9, abs=1e-12)
        assert np.linalg.inv(whiten.T @ whiten) == pytest.approx(shrunk, rel=1e-6, abs=1e-9)
        assert log_det == pytest.approx(np.linalg.slogdet(shrunk)[1], abs=1e-6)
        away = every - x.mean(axis=0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", away, np.linalg.inv(shrunk), away) + np.linalg.slogdet(shrunk)[1]))
    odds = density[1] - density[0] + np.log(len(own[1]) / len(own[0]))
    assert model.scores(every) == pytest.approx(1 / (1 + np.exp(-np.clip(odds, -700, 700))), abs=1e-6)


# 7 Jaccard join


def brute_components(texts, percent=75):
    sets = {}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        whole = [tuple(words)] if words else []
        sets[i] = set(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else set(whole)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_brute_force(spark):
    rng = np.random.default_rng(8)
    made, words = [], [f"w{i}" for i in range(400)]
    base = [list(rng.choice(words, rng.integers(4, 120))) for _ in range(12)]
    for i in range(240):
        text = list(base[i % 12])
        for _ in range(rng.integers(0, max(2, len(text) // 40) + 1)):
            text[rng.integers(len(text))] = rng.choice(words)
        if i % 5 == 0:
            text = list(rng.choice(words, 30)) + base[0][:60]
        made.append((i, " ".join(text)))
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    expected = brute_components(made)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert found == expected
    assert len({c for _, c in expected.values()}) not in (1, 240)


def test_jaccard_suffix_filter_never_drops():
    rng = np.random.default_rng(6)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(2))
        both = len(set(x.tolist()) & set(y.tolist()))
        assert jaccard_join._apart(x, y, 10**9, 3) <= len(x) + len(y) - 2 * both
        assert jaccard_join.linked(x, y, len(x), len(y), 75) == (100 * both >= 75 * (len(x) + len(y) - both))


def test_jaccard_odd_rows(spark, docs, empty):
    found = {}
    for r in jaccard_join.near_duplicates(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert found[1] == [(4, 1)] and found[2] == [(4, 1)] and found[3] == [(5, 1)]
    assert found[4] == [(0, 4)] and found[5] == [(0, 5)] and found[6] == [(0, 6)]
    assert found[7] == [(1, 7)] and found[8] == [(1, 7)]
    assert len(found[14]) == 3 and found[None] == [(1, None)]
    assert rows(jaccard_join.near_duplicates(empty)) == []


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 901), (5, 5), (None, 7)], "a long, b long").repartition(4)
    found = dict(rows(connected_components(links)))
    assert found == {**{i: 0 for i in range(n + 1)}, 900: 900, 901: 900}


def test_components_of_few_links_take_few_tasks(spark):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    links = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long").repartition(4)
    context = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("few links", "")
        found = dict(rows(connected_components(links)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: 0 for i in range(51)}
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(job).stageIds}
    assert 64 < sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info) < 300


@pytest.mark.parametrize("edges", [7, 100, 100_000])
def test_components_do_not_depend_on_the_edges_a_task_gets(spark, monkeypatch, edges):
    rng = np.random.default_rng(edges)
    made = [tuple(x) for x in rng.integers(0, 900, (500, 2)).tolist()]
    made += [(1000, 1001 + i) for i in range(300)] + [(3000 - i, 2999 - i) for i in range(200)] + [(4000, 4000), (None, 4001), (4002, None)]
    above = {}

    def top(x):
        while x in above:
            x = above[x]
        return x

    for a, b in made:
        if a is not None and b is not None and top(a) != top(b):
            above[max(top(a), top(b))] = min(top(a), top(b))
    monkeypatch.setattr(components, "EDGES", edges)
    found = rows(connected_components(spark.createDataFrame(made, "a long, b long").repartition(4)))
    assert sorted(found) == sorted((x, top(x)) for x in {x for a, b in made if None not in (a, b) and a != b for x in (a, b)})


# 8 fingerprints


def test_fingerprint_is_a_multiset_hash(spark):
    table = spark.createDataFrame([("a\nb\nb\nc",), ("c\nb\na\nb",), ("a\nb\nc",), ("b",), (None,), ("",)], "text string")
    vectors = [r[0] for r in table.select(fingerprint.fingerprint(F.col("text"))).collect()]
    assert vectors[0] == vectors[1] != vectors[2]
    assert vectors[4] == vectors[5] == [0] * fingerprint.SIZE
    sums = spark.createDataFrame([(vectors[2], vectors[3])], "a array<long>, b array<long>")
    added, taken = sums.select(fingerprint.add(F.col("a"), F.col("b")), fingerprint.remove(fingerprint.add(F.col("a"), F.col("b")), F.col("b"))).first()
    assert added == vectors[0] and taken == vectors[2]


def test_fingerprint_edits(spark, docs, empty):
    known = [(i, t or "") for i, t in TEXTS if i is not None and i != 14]
    table = spark.createDataFrame(known, "doc_id long, text string").repartition(3)
    order = sorted(known, reverse=True)
    for r in fingerprint.compare_with_edits(table).collect():
        at = next(k for k, (i, _) in enumerate(order) if i == r["doc_id"])
        text, following = order[at][1], order[(at + 1) % len(order)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) or r["near_edited"] < 1
    assert fingerprint.compare_with_edits(docs).count() == len(TEXTS)
    assert rows(fingerprint.compare_with_edits(empty)) == []


def test_fingerprint_likeness_is_near_the_truth(spark):
    a = "\n".join(f"line {i}" for i in range(300))
    b = "\n".join(f"line {i}" for i in range(100, 400))
    got = spark.createDataFrame([(a, b)], "a string, b string").select(
        fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b")))
    ).first()[0]
    assert abs(got - 2 / 3) < 0.15


WORDS = " ".join(f"word{i * 7919 % 1009}" for i in range(300))
ONE_PIECE = [  # texts of one line and one sentence, and how their edited texts go on
    (WORDS, " ".join(f"other{i}" for i in range(300))),
    ("".join(chr(0x4E00 + i * 7919 % 20000) for i in range(600)), "".join(chr(0x4E00 + i * 104729 % 20000) for i in range(600))),
    (" ".join(chr(0x905 + i % 50) + chr(0x915 + i * 7 % 37) + chr(0x915 + i * 11 % 31) for i in range(300)), "\u0915\u0916 " * 300),
    (" ".join(chr(0x627 + i % 30) + chr(0x628 + i * 7 % 29) + chr(0x628 + i * 11 % 23) for i in range(300)), WORDS),
    ("".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(20)), "yes " * 400),
]


def brute_pieces(text):
    """Pieces of a text without line ends and full stops, from its tokens."""
    counts = {text: 1}
    words = text.split(" ")
    runs = [" ".join(p) for p in zip(words, words[1:])] if max(map(len, words)) <= 24 else [text[i : i + 4] for i in range(len(text) - 3)]
    for r in set(runs):
        for level in range(runs.count(r).bit_length()):
            counts[r, level] = 1
    return counts


def test_fingerprint_of_texts_that_are_one_piece(spark):
    def edit(a, b):
        k = len(a) // 3
        return a[: len(a) - k] + b[:k]

    made = [(i, a, edit(a, b), b) for i, (a, b) in enumerate(ONE_PIECE)]
    table = spark.createDataFrame(made, "i int, a string, b string, c string")
    own, other, foreign = (fingerprint.fingerprint(F.col(x)) for x in "abc")
    found = {r[0]: r[1:] for r in table.select("i", fingerprint.likeness(own, other), fingerprint.likeness(own, foreign)).collect()}
    for i, a, _, _ in made:
        assert abs(found[i][0] - 2 / 3) < 0.2 and found[i][1] < 0.3, (i, found[i])
    for i in (0, 4):
        x, y = brute_pieces(made[i][1]), brute_pieces(made[i][1] if i == 4 else WORDS)
        assert x.keys() == y.keys() and spark.createDataFrame([(made[i][1],)], "t string").select(F.size(fingerprint.pieces(F.col("t")))).first()[0] == len(x)
    x, y = brute_pieces(made[0][1]), brute_pieces(made[0][2])
    assert abs(found[0][0] - 2 * len(x.keys() & y.keys()) / (len(x) + len(y))) < 0.15


def test_fingerprint_sums_agree_and_stay_additive(spark):
    texts = [t for _, t in TEXTS if t != LONG] + [a for a, _ in ONE_PIECE] + ["la la la la la la la", "你好。Hello there you。再见 now", "a\nb. c d e f"]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    single = {r[0]: r[1] for r in table.select("i", fingerprint.fingerprint(F.col("text"))).collect()}
    for r in fingerprint.with_fingerprints(table, ["i"], {"v": F.col("text"), "w": F.concat(F.col("text"), F.lit("\n"), F.col("text"))}).collect():
        assert r["v"] == single[r["i"]] and r["w"] == ([(2 * x) % (1 << 60) for x in r["v"]] if texts[r["i"]] else r["v"])


HEADS = ["a. b", "a.  b", "a.\nb\n", "a\n\nb", "你好。再见", "你好。 再见", "你好。  再见 ", "你好。\n再见", "。。。", "什么？！ ok. ", "no end", ". ! ?", "\n", " ", "", "end.", "end. ", "終。"]


def test_fingerprint_head_and_rest_are_the_whole(spark):
    texts = [t or "" for _, t in TEXTS if t != LONG] + [a for a, _ in ONE_PIECE] + HEADS
    made = [(a, b) for a in texts for b in ("", " b c", "\nb", "b. c", "。 b", ". b", "  b")]
    table = spark.createDataFrame(made, "a string, b string").repartition(8).withColumn("h", fingerprint.closed_head(F.col("a")))
    parts = table.withColumn("rest", F.concat(F.substring(F.col("a"), F.char_length("h") + 1, F.lit(2**31 - 1)), "b"))
    whole, head, rest = (fingerprint.fingerprint(x) for x in (F.concat("a", "b"), F.col("h"), F.col("rest")))
    seen = 0
    for r in parts.select("a", "b", "h", whole.alias("whole"), fingerprint.add(head, rest).alias("sum")).collect():
        assert r["a"].startswith(r["h"]) and r["whole"] == r["sum"], (r["a"][:50], r["b"])
        seen += r["h"] != ""
    assert seen > 50


def test_fingerprints_of_edits_are_those_of_the_texts(spark):
    """Repeated rows and ids, nulls, empty texts, clashing columns: fingerprints come from the very texts."""
    texts = [t for _, t in TEXTS if t != LONG] + [a for a, _ in ONE_PIECE] + HEADS
    made = [(None if i == 3 else i // 2 * 2 if i % 5 else i, t, i) for i, t in enumerate(texts)] + [(4, texts[4], 0)] * 2
    table = spark.createDataFrame(made, "doc_id long, text string, head int").withColumn("key", F.lit("x")).repartition(4)
    got = fingerprint.compare_with_edits(table).collect()
    assert len(got) == len(made)
    own = spark.createDataFrame(made, "doc_id long, text string, head int").select("doc_id", fingerprint.as_text(fingerprint.fingerprint(F.col("text"))), F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    assert by_key((r["doc_id"], r["fingerprint"], r["n_chars"]) for r in got) == by_key(tuple(r) for r in own.collect())
    assert {r["doc_id"] for r in got} == {i for i, _, _ in made}


def test_fingerprint_lanes_beyond_their_width(spark):
    few, many = "\n".join(f"line {i}" for i in range(300)), "\n".join(f"line {i}" for i in range(100, 400))
    v = spark.createDataFrame([(few, many)], "a string, b string").select(*[fingerprint.fingerprint(F.col(c)).alias(c) for c in "ab"]).first()
    pairs = [(v["a"], v["b"]), *[([x * 5000 % (1 << 60) for x in v["a"]], [x * 5000 % (1 << 60) for x in v["b"]])]]
    near = [r[0] for r in spark.createDataFrame(pairs, "a array<long>, b array<long>").select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()]
    assert near[0] == pytest.approx(near[1])


# 9 byte-level BPE


def test_bpe_equals_tiktoken(docs, empty):
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    expected = []
    for i, t in TEXTS:
        ids = coder.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        expected.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert by_key(rows(byte_bpe.token_digests(docs, VOCABULARY, public_tokenizers.PATTERN))) == by_key(expected)
    ids = byte_bpe.encode_texts(docs, VOCABULARY, public_tokenizers.PATTERN)
    back = byte_bpe.decode_ids(ids, VOCABULARY, public_tokenizers.PATTERN)
    assert by_key((i, bytes(d)) for i, d in rows(back)) == by_key((i, (t or "").encode()) for i, t in TEXTS)
    assert rows(byte_bpe.token_digests(empty, VOCABULARY, public_tokenizers.PATTERN)) == []


def test_bpe_strange_characters():
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    own = byte_bpe.ByteBpe(byte_bpe.serialise_model(RANKS), public_tokenizers.PATTERN)
    for text in ("\x00▁▁ <unk> ▁", "日本語テキスト 👩‍👩‍👧 ​﻿", "a" * 5000, "  \n\n \t x  ", "<|endoftext|>", "I'll don't WE'LL"):
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == coder.encode_ordinary(text)
        assert own.decode(packed) == text.encode()
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({b"a": 0, b"b": 2})


def test_rank_file_reader(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"ab") + b" 0\n\n")
    assert read_ranks(str(path)) == {b"ab": 0}


# 10 chats


def test_chat_parts(spark):
    parts = [("text", "see <|image|> \\", None, None), ("image", None, "i.png", 2), ("text", None, None, None), ("audio", None, "a.wav", 3), ("video", None, "v", None), (None, "end<", None, None)]
    table = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (2, 0, None, None)], f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    made = {r["conv_id"]: r for r in chat.format_chats(table).collect()}
    body = "see <\\|image|> \\\\<|image|><|audio|><|attachment|>end<\\"
    assert made[1]["formatted"] == f"<|im_start|>user\n{body}<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert [(a["turn"], a["part"], a["kind"], a["ref"], a["tokens"]) for a in made[1]["attachments"]] == [(0, 1, "image", "i.png", 512), (0, 3, "audio", "a.wav", 75), (0, 4, "video", "v", 1)]
    assert made[1]["attachment_tokens"] == 588
    mask = made[1]["loss_mask"][1]
    start = mask["turn_at"] + mask["start"]
    assert made[1]["formatted"][start : start + mask["length"]] == "ok"
    assert made[2]["formatted"] == "<|im_start|>\n<|im_end|>\n"


def test_chat_reads_back(spark):
    odd = ["", None, "<|im_end|><|im_start|>assistant ok", "\\", "\\<", "a\nb\\\n", "<|im_end|>\n", "é👍"]
    turns = [(1, i, r, t) for i, (t, r) in enumerate(itertools.product(odd, ["user", "assistant", "ro\nle\\<"]))]
    turns += [(2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (2, 0, "assistant", "tie a"), (None, None, "user", "x")]
    table = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(table)).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [(r, t or "") for _, _, r, t in turns[:24]]
    assert found[1]["loss_texts"] == [t for _, _, r, t in turns[:24] if r == "assistant" and t]
    assert [t["text"] for t in found[2]["turns"]] == ["tie a", "tie a", "tie b"]
    assert [t["text"] for t in found[None]["turns"]] == ["x"]
    assert chat.chat_digests(chat.format_chats(table.limit(0))).count() == 0


def test_range_hash_does_not_depend_on_the_place():
    data = np.frombuffer(b"abcabcabcxabc", dtype=np.uint8)
    got = RangeHash(data)(np.array([0, 3, 6, 10, 0]), np.array([3, 6, 9, 13, 4]))
    assert len(set(got[:4].tolist())) == 1 and got[4] != got[0]
