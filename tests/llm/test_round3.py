"""Toxicity, token alignment and the prefix trie against brute force, with odd rows."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulane.llm import prefix_trie, token_alignment, toxicity
from tests.llm.test_operators import by_key, docs, empty, rows  # noqa: F401

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")

# 11 toxicity

VOTES = "votes long, n long"


def patterns_of(spark, votes):
    counted = collections.Counter(toxicity.pack_votes(v) for v in votes)
    return spark.createDataFrame(list(counted.items()), VOTES)


def drawn_votes(n, seed=3):
    """Votes of a known model: voters 0 to 3 err alone, voter 4 repeats voter 3, labels of a third of the rows err in 1 of 20."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.3
    votes = np.zeros((n, len(toxicity.VOTERS)), int)
    for j, right in enumerate((0.95, 0.9, 0.85, 0.8)):
        votes[:, j] = np.where((rng.random(n) < right) == truth, toxicity.TOXIC, toxicity.CLEAN)
    votes[:, 4] = votes[:, 3]
    label = (rng.random(n) < 0.95) == truth
    votes[:, toxicity.ANNOTATOR] = np.where(rng.random(n) < 1 / 3, np.where(label, toxicity.TOXIC, toxicity.CLEAN), toxicity.ABSTAIN)
    return truth, votes


def test_label_model_finds_accuracies_and_correlations(spark):
    truth, votes = drawn_votes(20_000)
    model = toxicity.fit_label_model(patterns_of(spark, votes.tolist()))
    for name, right in zip(toxicity.VOTERS, (0.95, 0.9, 0.85, 0.8, 0.8)):
        assert abs(model.accuracies[name] - right) < 0.03
    assert (toxicity.VOTERS[3], toxicity.VOTERS[4]) in model.correlations
    found = model.posterior(votes) >= 0.5
    alone = votes[:, 0] == toxicity.TOXIC
    assert np.mean(found == truth) > 0.95 > np.mean((votes[:, 3] == toxicity.TOXIC) == truth) and np.mean(found == truth) >= np.mean(alone == truth)


def test_label_model_needs_no_labels(spark):
    truth, votes = drawn_votes(8000, seed=4)
    votes[:, toxicity.ANNOTATOR] = toxicity.ABSTAIN
    model = toxicity.fit_label_model(patterns_of(spark, votes.tolist()))
    assert np.mean((model.posterior(votes) >= 0.5) == truth) > 0.9


def test_posterior_is_the_product_of_the_tables(spark):
    _, votes = drawn_votes(3000)
    model = toxicity.fit_label_model(patterns_of(spark, votes.tolist()), rounds=3)
    for v, p in zip(votes[:20], model.posterior(votes[:20])):
        log = [
            model.log_prior[y] + sum(model.tables[y, j, v[k] if k >= 0 else 0, v[j]] for j, k in enumerate(model.parents)) for y in (0, 1)
        ]
        assert p == pytest.approx(np.exp(log[1]) / np.exp(log).sum(), abs=1e-9)


def test_joint_counts_add_up():
    rng = np.random.default_rng(1)
    votes, weights = rng.integers(0, 3, (40, len(toxicity.VOTERS))), rng.random((40, 2))
    found = toxicity.joint_counts(votes, weights)
    for y, j, k, a, b in [(0, 0, 1, 2, 1), (1, 3, 3, 1, 1), (1, 5, 2, 0, 2)]:
        assert found[y, j, a, k, b] == pytest.approx(weights[(votes[:, j] == a) & (votes[:, k] == b), y].sum())
    assert toxicity.unpack_votes(np.array([toxicity.pack_votes(v) for v in votes.tolist()])).tolist() == votes.tolist()


def test_stems_need_several_contexts(spark):
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i, j in itertools.product(range(20), repeat=2)]
    toxic = [(f"{words[3 * i]} {words[i]} grumbelx{'abcdefgh'[i % 8]} {words[2 * i]} fixed copied", 1) for i in range(40)]
    clean = [(f"{words[i]} {words[-i]} {words[5 * i % 400]}", 0) for i in range(200)]
    found = toxicity.learn_stems(spark.createDataFrame(toxic + clean, "text string, label int"))
    assert {"^grum", "^grumb", "^grumbel"[:8]} & set(found) and "=copied" not in found  # one context only
    assert toxicity.learn_stems(spark.createDataFrame(clean, "text string, label int")) == {}


def test_toxicity_held_out(spark, data):
    from tabulane.llm.queries import op11_toxicity

    found = op11_toxicity(spark, data)
    table = spark.read.parquet(f"{data}/documents.parquet")
    assert found.count() == table.count()
    insults = "idiot|moron|stupid|worthless|pathetic|trash|scum|loser|clown|disgusting"
    for r in found.join(table, "doc_id").collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert not any(w in r["text"].lower().split() for w in insults.split("|")) or r["predicted"] == 1


def test_toxicity_odd_rows(spark, docs, empty):  # noqa: F811
    told = [(1, 1), (1, 0), (2, None), (3, 5), (9, 0), (None, 1), (99, 1)]
    labels = spark.createDataFrame(told, "doc_id long, toxic int")
    model, _ = toxicity.learn_toxicity(docs, labels, F.lit(True))
    found = rows(toxicity.score_toxicity(docs, model))
    assert len(found) == docs.count() and all(0 <= s <= 1 for _, s in found)
    assert len({s for i, s in found if i in (4, 5, 6)}) == 1  # null, empty and blank texts are alike
    assert toxicity.score_toxicity(empty, model).count() == 0
    learned, _ = toxicity.learn_toxicity(empty, labels.limit(0), F.lit(True))
    assert 0 <= learned.score(learned.reader(), "you idiot") <= 1


def test_score_is_the_product_of_the_features():
    rng = np.random.default_rng(0)
    model = toxicity.Toxicity({"^grum": 5.0, "=lowei": 3.0}, rng.normal(size=toxicity.DENSE), rng.normal(size=toxicity.BUCKETS), 0.3)
    reader = model.reader()
    for text in (None, "", "you stupid grumbel grumbel", "LOOK HERE NOW f**k!! lowei", "plain words only, twice plain"):
        dense, at, value = reader.features(text)
        odds = dense @ model.dense + value @ model.hashed[at] + 0.3
        assert model.score(reader, text) == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-12)


def test_annotators_outvoted(spark):
    """Wrong labels of a few clean rows do not make them toxic, and unlabelled insults are found."""
    rng = np.random.default_rng(5)
    plain = "river stone garden window morning paper silver mountain letter winter".split()
    bad = "idiot moron worthless pathetic scum".split()
    made = [(i, " ".join(rng.choice(plain, 30).tolist() + (rng.choice(bad, 3).tolist() if i % 5 == 0 else []))) for i in range(400)]
    labels = [(i, int(i % 5 == 0 or i % 50 == 1)) for i, _ in made if i % 2]
    table = spark.createDataFrame(made, "doc_id long, text string")
    model, _ = toxicity.learn_toxicity(table, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    for i, score in rows(toxicity.score_toxicity(table, model)):
        assert (score >= 0.3) == (i % 5 == 0)


# 12 alignment


def brute_alignment(made):
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    found, counts = [], collections.Counter()
    for i, text in made:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        parts = [[token_alignment.entry_bytes(a_side.id_to_token(x)) for x in a], [token_alignment.piece_bytes(b_side.id_to_piece(x)) for x in b]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            a, b, parts = [], [], [[], []]
        ends_a, ends_b = ([*itertools.accumulate(map(len, p))] for p in parts)
        of_b = dict(zip(ends_b, b))
        links = [(x, of_b[e]) for e, x in zip(ends_a, a) if e in of_b]
        counts.update(links)
        groups, at_a, at_b = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        found.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (i, n_a, n_b, n_groups, len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, n_a, n_b, n_groups, links, g in found
    ]


ODD_TEXTS = [
    None, "", "  two  spaces ", "a▁b", "x" * 3000, "<|endoftext|> hi </s> <s>", "é ü\n\n z  \t q", "ﬁ ﬀ № ①", "日本語 テキスト 🙂👨‍👩‍👧",
    " lead", "trail ", "\x00 null", "don't it's ' s", "a\n b\n \n c", " ", " nbsp   wide", "ok ok ok ok",
]


def test_alignment_by_brute_force(spark, docs, empty, data):  # noqa: F811
    odd = [(i // 2, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (None, "no id")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in odd], "doc_id long, text string, row int, links string").repartition(3)
    assert by_key(rows(token_alignment.alignment_digests(table, A, B))) == by_key(brute_alignment(odd))
    made = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()[:60]]
    some = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    assert by_key(rows(token_alignment.alignment_digests(some, A, B))) == by_key(brute_alignment(made))
    assert token_alignment.alignment_digests(empty, A, B).count() == 0


def test_alignment_in_blocks_and_salts(spark, data, monkeypatch):
    some = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(50)
    whole = by_key(rows(token_alignment.alignment_digests(some, A, B)))
    monkeypatch.setattr(token_alignment, "BLOCK_PAIRS", 300)
    monkeypatch.setattr(token_alignment, "SALT_LINKS", 500)
    assert by_key(rows(token_alignment.alignment_digests(some, A, B))) == whole


def test_links_and_cuts_are_offsets(spark):
    text = "wonderful bytes, andere Wörter"
    r = token_alignment.align_tokens(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), A, B).orderBy("doc_id").collect()
    coder = token_alignment.PairCoder(open(A, encoding="utf-8").read(), open(B, "rb").read())
    a_ends, b_ends = ([*itertools.accumulate(len(side[i]) for i in ids)] for side, ids in ((coder.a_bytes, r[0]["a_ids"]), (coder.b_bytes, r[0]["b_ids"])))
    assert [(a_ends[x["a"]], b_ends[x["b"]]) for x in r[0]["links"]] == [(c, c) for c in r[0]["cuts"]]
    assert r[0]["cuts"] == sorted(set(a_ends) & set(b_ends)) and r[0]["cuts"][-1] == len((" " + text).encode())
    assert r[1]["a_ids"] == r[1]["links"] == r[1]["cuts"] == []


def test_lockstep_walks_lanes():
    rng = np.random.default_rng(2)
    sizes = [1, 5000, 3, 0, 70_000]
    starts = np.cumsum([0, *sizes[:-1]])
    ends = [np.unique(np.concatenate([rng.integers(1, sum(sizes), n), np.cumsum([s for s in sizes if s])])) for n in (20_000, 9000)]
    known = [i for i, s in enumerate(sizes) if s]
    partner = token_alignment.lockstep(ends[0], ends[1], starts[known], sum(sizes))
    assert [(e, ends[1][p]) for e, p in zip(ends[0].tolist(), partner.tolist()) if p >= 0] == [(e, e) for e in np.intersect1d(*ends).tolist()]
    assert len(token_alignment.lockstep(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 0)) == 0


# 13 trie

TURNS = "conv_id long, turn long, role string, text string, path string, shard int"


def brute_trie(made):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in made:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    plain = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(plain.get(c - c % 5, [])[:h] + own[h:])
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved, found = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in children[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        above = min(members[p[:-1]]) if p else None
        found.append((min(members[p]), len(p), above, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return found


def test_trie_by_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    made = rows(table.select("conv_id", "turn", "role", "text"))
    assert by_key(rows(prefix_trie.conversation_trie(table))) == by_key(brute_trie(made))


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_trie_of_odd_and_hot_rows(spark, shards):
    made = [(c, t, "user" if t % 2 == 0 else None, "same first" if t < 2 else f"{c % 7}é" if t < 4 else None) for c in range(0, 300) for t in range(c % 6 + 1)]
    made += [(10_000 + 5 * c, t, "r", f"t{t}") for c in range(200) for t in range(9)]  # one conversation, 200 times
    made += [(7, None, "null", "turn"), (7, 0, "tie", "a"), (7, 0, "tie", "b"), (7, 0, "tie", "b"), (None, 1, "no", "id"), (20_003, 5, None, ""), (30_000, 0, "x", "long " * 50_000)]
    table = spark.createDataFrame([(*r, "p", 1) for r in made], TURNS).repartition(5)
    assert by_key(rows(prefix_trie.conversation_trie(table, shards))) == by_key(brute_trie(made))


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "p", 1)], TURNS)).count() == 0
    lone = rows(prefix_trie.prefix_trie(spark.createDataFrame([(4, bytearray()), (3, bytearray()), (None, bytearray()), (9, None)], "conv_id long, path binary")))
    assert lone == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]


def test_splitters_cut_equal_paths(spark):
    same = spark.createDataFrame([(i, bytearray(b"a" * 16 + (5).to_bytes(8, "big"))) for i in range(4000)], "conv_id long, path binary")
    assert len(prefix_trie.choose_splitters(same, 8)) >= 6
    found = rows(prefix_trie.prefix_trie(same, 8))
    ends = hashlib.sha256(",".join(map(str, range(4000))).encode()).hexdigest()
    assert [r for r in found if r[1] == 1][0][3:] == (4000, 0, 1, 3999 * 5, ends)


# 7 near duplicates


def test_texts_that_only_a_polynomial_confuses_stay_apart(spark):
    from tabulane.llm import jaccard_join

    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    made = [word[:1024], other[:1024], word, other, f"own words here now {word} end", f"own words here now {other} end", "x " + word, "x " + other]
    found = rows(jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")))
    assert all(component == i for i, _, component in found)


def test_links_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    from tabulane.llm import jaccard_join
    from tests.llm.test_operators import brute_components

    rng = np.random.default_rng(3)
    base, made = [f"w{i}" for i in range(120)], []
    for i in range(400):  # a pair is linked if its changed words, 1 to 13 each, are few enough together
        n = int(rng.integers(1, 14))
        at = int(rng.integers(0, len(base) - n))
        made.append((i, " ".join([*base[:at], *(f"own{i}x{k}" for k in range(n)), *base[at + n :]])))
    docs, found = spark.createDataFrame(made, "doc_id long, text string").repartition(4), []

    def counted(kept, percent, links=jaccard_join.linked_classes):
        out = jaccard_join.cut_lineage(links(kept, percent))
        found.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "linked_classes", counted)
    expected = brute_components(made)
    for further in (0, 1 << 30):  # with and without further rounds of stars
        monkeypatch.setattr(jaccard_join, "OPEN_PAIRS", further, raising=False)
        assert {r[0]: tuple(r[1:]) for r in jaccard_join.near_duplicates(docs).collect()} == expected
    assert 1 < len({c for _, c in expected.values()}) < 200
    assert max(found) < 5 * len(made)
