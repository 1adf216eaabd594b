"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier on its posteriors.

Voters are lexicons, patterns and word stems learned from labelled rows; each says toxic, clean or nothing. The label model
is a latent class with a tree of dependences between voters (per class, each voter depends on one other), fitted by EM over the
distinct vote patterns of all documents; the annotators' labels are one more voter, so noisy labels are outvoted. A logistic
regression over counts and hashed words then learns the posteriors and scores any text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.llm.common import over_batches
from tabulane.session import cut_lineage

# Words that speak for themselves, in four languages.
LEXICONS = {
    "insult": "idiot idiots moron morons loser losers fool fools clown clowns imbecile jerk creep dummy coward weirdo trottel dummkopf versager arschloch depp "
    "imbécile crétin abruti connard salaud tonto imbécil estúpido cabrón payaso",
    "contempt": "stupid worthless pathetic disgusting useless dumb ugly despicable hateful repulsive dumm wertlos erbärmlich widerlich ekelhaft nutzlos "
    "stupide pathétique dégoûtant minable nul inútil asqueroso patético despreciable",
    "waste": "trash scum garbage filth vermin parasite parasites maggot maggots abschaum dreck müll ungeziefer ordure ordures racaille vermine basura escoria",
    "profanity": "damn crap bastard bastards bitch shit fuck fucking asshole scheisse scheiße verdammt hurensohn merde putain salope mierda puta joder",
    "threat": "kill murder strangle exterminate lynch umbringen vernichten töten tuer égorger matar exterminar",
}
VOTERS = (
    *LEXICONS, "several", "dense", "addressed", "shouting", "exclaiming", "masked", "stem", "stems", "evidence", "no_lexicon", "no_stem", "calm", "annotator",
)
ABSTAIN, TOXIC, CLEAN = range(3)
ANNOTATOR = len(VOTERS) - 1

MINED_ROWS = 5_000  # labelled rows of each class that stems are learned from, the ones of the smallest hashes
LEAST_ROWS = 6  # toxic rows a stem has to occur in
LEAST_BITS = 5  # of 64: different words before it, so that a passage that is only copied teaches nothing
STEMS = 5_000  # stems kept
STRONG, WEAK = 4.0, 2.0  # log likelihood ratios of a stem
FITTED_ROWS = 12_000  # rows of each posterior class the classifier is fitted to, the ones of the smallest hashes
BUCKETS = 4096  # hashed words
ROUNDS = 10
TRUST = 0.5  # imagined labels that are right, as a share of the given ones
ACCEPT = 0.3

_WORDS = regex.compile(r"[^\W\d_]+").findall
_SHOUT = regex.compile(r"\b\p{Lu}{3,}\b(?:\W+\b\p{Lu}{3,}\b){2}").search
_EXCLAIM = regex.compile(r"[!?]*![!?]+|\?!").search
_MASK = regex.compile(r"\p{L}[*#@]{2,}\p{L}").search
_MASKS = frozenset("*#@")
_YOU = frozenset("you your youre u du dich dir ihr dein tu toi vous ton tú usted vosotros eres".split())
_OF_WORD = {w: 1 << i for i, words in enumerate(LEXICONS.values()) for w in words.split()}
COUNTS = (*LEXICONS, "lexicon", "stem", "weak_stem", "evidence", "addressed", "shouting", "exclaiming", "masked", "words")


def units(word: str) -> list[str]:
    """A word and its beginnings of four to seven letters."""
    return ["=" + word, *["^" + word[:n] for n in range(4, min(7, len(word)) + 1)]]


def bucket(word: str) -> tuple[int, float]:
    code = zlib.crc32(word.encode())
    return code % BUCKETS, 1.0 if code >> 31 else -1.0


class Reader:
    """Counts and votes of a text. Words that say nothing are remembered up to a bound, so that most of a text is passed over at once."""

    MEMO = 400_000

    def __init__(self, stems: dict[str, float], weights: np.ndarray | None = None):
        self.stems, self.weights = stems, weights
        self.heads = {u[1:5] for u in stems}  # a word with a stem starts like one of these
        self.silent, self.weight_of = set(), {}

    def _telling(self, seen: Counter) -> list[tuple[str, int, float]]:
        """(word, lexicons as bits, weight of its best unit) of the words that are in a lexicon or have a stem."""
        found = []
        if len(self.silent) >= self.MEMO:
            self.silent.clear()
        heads = self.heads
        for word in set(seen).difference(self.silent):
            if word[:4] not in heads and word not in _OF_WORD:
                self.silent.add(word)
                continue
            bits, weight = _OF_WORD.get(word, 0), max(self.stems.get(u, 0.0) for u in units(word))
            if bits or weight >= WEAK:
                found.append((word, bits, weight))
            else:
                self.silent.add(word)
        return sorted(found)

    def read(self, text: str | None) -> tuple[dict[str, float], list[int], Counter]:
        """(counts by name, votes of all voters but the annotator, words) of a whole text; null reads as empty."""
        text = text or ""
        words = _WORDS(text.lower())
        seen = Counter(words)
        n = dict.fromkeys(COUNTS, 0.0)
        n["words"] = float(len(words))
        lexicon_words, evidence = set(), 0.0
        for word, bits, weight in self._telling(seen):
            if bits:
                lexicon_words.add(word)
                n["lexicon"] += seen[word]
                for i, name in enumerate(LEXICONS):
                    if bits >> i & 1:
                        n[name] += seen[word]
            if weight >= WEAK:
                n["stem" if weight >= STRONG else "weak_stem"] += 1
                evidence += weight
        n["evidence"] = min(evidence, 40.0)
        if lexicon_words:
            n["addressed"] = float(sum(w in lexicon_words and not _YOU.isdisjoint(words[max(0, i - 4) : i]) for i, w in enumerate(words)))
        n["shouting"] = float(_SHOUT(text) is not None)
        n["exclaiming"] = float("!" in text and _EXCLAIM(text) is not None)
        n["masked"] = float(not _MASKS.isdisjoint(text) and _MASK(text) is not None)
        toxic = [n[name] > 0 for name in LEXICONS]
        toxic += [len(lexicon_words) >= 2, n["lexicon"] * 100 >= max(1.0, n["words"]), n["addressed"] > 0, n["shouting"] > 0, n["exclaiming"] > 0, n["masked"] > 0]
        toxic += [n["stem"] >= 1, n["stem"] >= 2, n["evidence"] >= 8]
        clean = [not lexicon_words, n["evidence"] == 0, not (n["shouting"] or n["exclaiming"] or n["masked"])]
        return n, [TOXIC if x else ABSTAIN for x in toxic] + [CLEAN if x else ABSTAIN for x in clean], seen

    @staticmethod
    def _dense(n: dict[str, float]) -> np.ndarray:
        """Log counts. How long a text is does not make it toxic, so the word count is left out."""
        return np.array([n[c] / 8 if c == "evidence" else math.log1p(n[c]) for c in COUNTS[:-1]])

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log counts, buckets, values) of a text: the log counts of its words, of length 1, signed and added up per bucket."""
        n, _, seen = self.read(text)
        if not seen:
            return self._dense(n), np.zeros(0, np.int64), np.zeros(0)
        counts = np.log1p(np.fromiter(seen.values(), float, len(seen)))
        places = [bucket(w) for w in seen]
        value = np.bincount([b for b, _ in places], weights=counts / np.linalg.norm(counts) * [s for _, s in places], minlength=BUCKETS)
        at = np.flatnonzero(value)
        return self._dense(n), at, value[at]

    def odds(self, text: str | None, dense: np.ndarray) -> float:
        """The product of the features with `dense` and the hashed weights."""
        n, _, seen = self.read(text)
        total = float(self._dense(n) @ dense)
        if seen:
            if len(self.weight_of) >= self.MEMO:
                self.weight_of.clear()
            for word in set(seen).difference(self.weight_of):
                b, sign = bucket(word)
                self.weight_of[word] = sign * self.weights[b]
            counts = np.log1p(np.fromiter(seen.values(), float, len(seen)))
            total += float(counts @ np.fromiter(map(self.weight_of.__getitem__, seen), float, len(seen)) / np.linalg.norm(counts))
        return total


DENSE = len(COUNTS) - 1


def pack_votes(votes: list[int]) -> int:
    return sum(v << 2 * i for i, v in enumerate(votes))


def unpack_votes(packed: np.ndarray) -> np.ndarray:
    """Rows of votes, the annotator's last."""
    return (packed[:, None] >> (2 * np.arange(len(VOTERS)))) & 3


class LabelModel(NamedTuple):
    """log P(class); order of voters, each after the one it depends on (-1: none); log P(vote | vote of that one, class) as [class, voter, other's vote, vote]."""

    log_prior: np.ndarray
    parents: list[int]
    tables: np.ndarray
    accuracies: dict[str, float]
    correlations: dict[tuple[str, str], float]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of rows of votes."""
        log = np.tile(self.log_prior, (len(votes), 1))
        for j, parent in enumerate(self.parents):
            other = votes[:, parent] if parent >= 0 else np.zeros(len(votes), np.int64)
            log += self.tables[:, j, other, votes[:, j]].T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def _tree(joint: np.ndarray) -> tuple[list[int], dict[tuple[int, int], float]]:
    """The heaviest tree of conditional mutual information, from `joint` [class, voter, vote, voter, vote]; links that say next to nothing are left out."""
    m = len(VOTERS)
    p = joint / joint.sum(axis=(2, 4), keepdims=True)
    single = np.array([[p[y, j, :, j, :].diagonal() for j in range(m)] for y in (0, 1)])
    share = joint[:, 0].sum(axis=(1, 3))[:, 0] / joint[:, 0].sum(axis=(1, 3))[:, 0].sum()
    product = single[:, :, :, None, None] * single[:, None, None, :, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log(p / np.where(product > 0, product, 1)), 0.0)
    weight = np.einsum("y,yjakb->jk", share, terms)
    weight[ANNOTATOR], weight[:, ANNOTATOR] = 0, 0  # who labels looks at the text alone
    parents, best, via = [-1] * m, np.full(m, -1.0), [-1] * m
    todo, kept, j = set(range(m)), {}, 0
    while todo:  # Prim's, from voter 0
        todo.discard(j)
        if via[j] >= 0 and best[j] > 1e-4:
            parents[j] = via[j]
            kept[(min(j, via[j]), max(j, via[j]))] = float(best[j])
        for k in todo:
            if weight[j, k] > best[k]:
                best[k], via[k] = weight[j, k], j
        j = max(todo, key=lambda k: best[k], default=0)
    return parents, kept


def model_of(joint: np.ndarray) -> LabelModel:
    """The label model of expected counts [class, voter, vote, voter, vote], smoothed by one count a class and vote.

    Whether a row was labelled says nothing, only how; half as many imagined labels as there are, 95 of 100 of them right, keep the classes what they are named.
    """
    parents, kept = _tree(joint + 1e-9)
    n = joint[:, 0].sum(axis=(1, 3))[:, 0]
    log_prior = np.log((n + 1) / (n.sum() + 2))
    tables = np.zeros((2, len(VOTERS), 3, 3))
    accuracies = {}
    for j, name in enumerate(VOTERS):
        own = np.array([joint[y, j, :, j, :].diagonal() for y in (0, 1)])
        said = own[:, 1:].sum()
        accuracies[name] = float((own[1, TOXIC] + own[0, CLEAN]) / said) if said else 0.5
        base = (own + 1) / (own.sum(axis=1, keepdims=True) + 3)
        if j == ANNOTATOR:
            spoken = own[:, 1:] + TRUST * (own[:, 1:].sum(axis=1, keepdims=True) + 1) * np.array([[0.05, 0.95], [0.95, 0.05]])
            tables[:, j, :, 1:] = np.log(spoken / spoken.sum(axis=1, keepdims=True))[:, None, :]
        elif parents[j] < 0:
            tables[:, j] = np.log(base)[:, None, :]
        else:  # what a rare vote of the other says is drawn toward the voter's own rate
            both = joint[:, parents[j], :, j, :]
            tables[:, j] = np.log((both + 3 * base[:, None, :]) / (both.sum(axis=2, keepdims=True) + 3))
    return LabelModel(log_prior, parents, tables, accuracies, {(VOTERS[a], VOTERS[b]): w for (a, b), w in kept.items()})


def joint_counts(votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[class, voter, vote, voter, vote] sums of `weights` (rows, class)."""
    m = len(VOTERS)
    said = np.zeros((len(votes), m, 3))
    np.put_along_axis(said, votes[:, :, None], 1.0, axis=2)
    flat = said.reshape(len(votes), 3 * m)
    return np.array([(flat * weights[:, y : y + 1]).T @ flat for y in (0, 1)]).reshape(2, m, 3, m, 3)


def _start(votes: np.ndarray, labelled_only: bool) -> np.ndarray:
    """First guess of P(toxic): the annotator's label, or the majority where there are none. Rows of weight zero stay out."""
    label = votes[:, ANNOTATOR]
    if labelled_only:
        return np.where(label == TOXIC, 0.95, 0.05)
    lead = (votes[:, :ANNOTATOR] == TOXIC).sum(axis=1) - (votes[:, :ANNOTATOR] == CLEAN).sum(axis=1)
    return 1 / (1 + np.exp(-1.5 * lead))


def fit_label_model(patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """EM over (votes long, n long): all distinct vote patterns and how often they occur.

    Each round is one aggregate of expected pair counts, a few thousand numbers; the patterns stay distributed. Where annotators gave
    both labels, the first round counts only their rows and so fixes which class is which; else the majority does.
    """
    label = F.shiftright("votes", 2 * ANNOTATOR)
    given = {r["label"]: r["n"] for r in patterns.groupBy(label.alias("label")).agg(F.sum("n").alias("n")).collect()}
    labelled = bool(given.get(TOXIC) and given.get(CLEAN))
    model, last = None, None
    for i in range(rounds):

        def expect(batches, model=model):
            total = np.zeros((2, len(VOTERS), 3, len(VOTERS), 3))
            for batch in batches:
                votes = unpack_votes(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                n = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                if model is None:
                    p = _start(votes, labelled)
                    n = n * (votes[:, ANNOTATOR] != ABSTAIN) if labelled else n
                else:
                    p = model.posterior(votes)
                total += joint_counts(votes, np.column_stack([(1 - p) * n, p * n]))
            at = np.flatnonzero(total)
            yield {"at": at, "value": total.ravel()[at]}

        rows = over_batches(patterns, expect, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        joint = np.zeros(2 * (3 * len(VOTERS)) ** 2)
        for r in rows:
            joint[r["at"]] = r["value"]
        model = model_of(joint.reshape(2, len(VOTERS), 3, len(VOTERS), 3))
        moved = None if last is None else np.abs(np.exp(model.tables) - np.exp(last.tables)).max()
        if moved is not None and moved < 1e-4:
            break
        last = model
    return model


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """`n` rows by the hash of their id, so the choice does not depend on the order of rows."""
    return rows.orderBy(F.xxhash64("id"), "id").limit(n)


def learn_stems(texts: DataFrame) -> dict[str, float]:
    """Log likelihood ratios of the stems of labelled rows (text, label): at most STEMS of them, learned from a bounded sample.

    A stem has to occur in LEAST_ROWS toxic rows and behind several different words.
    """

    def work(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            rows = [0, 0]
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _WORDS((text or "").lower())
                here: dict[str, int] = {}
                for before, word in zip(["", *words], words):
                    here[word] = here.get(word, 0) | 1 << zlib.crc32(before.encode()) % 64
                rows[label] += 1
                units_here: dict[str, int] = {}
                for word, bits in here.items():
                    for u in units(word):
                        units_here[u] = units_here.get(u, 0) | bits
                for u, bits in units_here.items():
                    known = found.setdefault(u, [0, 0, 0])
                    known[label] += 1
                    if label:
                        known[2] |= bits
            found[""] = [*rows, 0]
            values = list(found.values())
            signed = [v[2] - (1 << 64) if v[2] >> 63 else v[2] for v in values]
            yield {"unit": list(found), "clean": [v[0] for v in values], "toxic": [v[1] for v in values], "bits": signed}

    counted = over_batches(texts, work, "unit string, clean long, toxic long, bits long")
    sums = counted.groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("bits").alias("bits"))
    kept = cut_lineage(sums.filter((F.col("unit") == "") | ((F.col("toxic") >= LEAST_ROWS) & (F.bit_count("bits") >= LEAST_BITS))))
    whole = kept.filter("unit = ''").first()
    if whole is None or not whole["clean"] or not whole["toxic"]:
        return {}
    ratio = F.log((F.col("toxic") + 0.5) / (whole["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (whole["clean"] + 1.0))
    best = kept.filter("unit != ''").withColumn("weight", F.least(ratio, F.lit(6.0))).filter(F.col("weight") >= WEAK)
    return {r["unit"]: r["weight"] for r in best.orderBy(F.col("weight") * F.sqrt("toxic"), "unit", ascending=[False, True]).limit(STEMS).collect()}


class Toxicity(NamedTuple):
    """What scoring needs: stems, weights of the log counts and of the buckets, intercept."""

    stems: dict[str, float]
    dense: np.ndarray
    hashed: np.ndarray
    intercept: float

    def score(self, reader: Reader, text: str | None) -> float:
        odds = reader.odds(text, self.dense) + self.intercept
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, odds))))

    def reader(self) -> Reader:
        return Reader(self.stems, self.hashed)


def fit_classifier(rows: DataFrame, stems: dict[str, float]) -> Toxicity:
    """Logistic regression on (text, posterior, weight): each row counts for both classes, by its posterior."""

    def work(batches):
        reader = Reader(stems)
        for batch in batches:
            found = [reader.features(t) for t in batch.column(0).to_pylist()]
            yield {
                "at": [[*range(DENSE), *(DENSE + f[1]).tolist()] for f in found],
                "value": [[*f[0].tolist(), *f[2].tolist()] for f in found],
                "posterior": batch.column(1),
                "weight": batch.column(2),
            }

    @F.udf(VectorUDT())
    def vector(at, value):
        return SparseVector(DENSE + BUCKETS, dict(zip(at, value)))

    read = over_batches(rows.select("text", "posterior", "weight"), work, "at array<int>, value array<double>, posterior double, weight double")
    both = F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("p")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("p")))
    points = cut_lineage(read.select(vector("at", "value").alias("features"), "weight", F.explode(both).alias("_")).select("features", F.col("_.label").alias("label"), (F.col("weight") * F.col("_.p")).alias("w")).filter("w > 1e-6"))
    if points.select("label").distinct().count() < 2:
        one = points.select("label").first()
        return Toxicity(stems, np.zeros(DENSE), np.zeros(BUCKETS), 20.0 if one and one["label"] == 1.0 else -20.0)
    fitted = LogisticRegression(weightCol="w", regParam=1e-4, maxIter=60, standardization=False).fit(points)
    weights = fitted.coefficients.toArray()
    return Toxicity(stems, weights[:DENSE], weights[DENSE:], float(fitted.intercept))


def cast_votes(docs: DataFrame, stems: dict[str, float]) -> DataFrame:
    """(id, tag, votes): packed votes of every whole text; `tag` is the text's hash."""

    def work(batches):
        reader = Reader(stems)
        for batch in batches:
            yield {"id": batch.column(0), "tag": batch.column(1), "votes": [pack_votes(reader.read(t)[1]) for t in batch.column(2).to_pylist()]}

    kind = docs.schema["id"].dataType.simpleString()
    return over_batches(docs.select("id", F.xxhash64("text").alias("tag"), "text"), work, f"id {kind}, tag long, votes long")


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Toxicity, LabelModel]:
    """The classifier and the label model it learned from.

    Labels are read for the rows of `docs` that meet `learn` only; labels other than 0 and 1 count as none, and of several labels of one id the
    smallest counts. Rows with a null id vote but are not learned from. All documents' votes enter the label model; stems come from at
    most MINED_ROWS labelled rows a class, the classifier from at most FITTED_ROWS rows a posterior class.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    own = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    may = cut_lineage(docs.filter("_learn AND id IS NOT NULL").select("id").distinct().join(own, "id"))
    some = [_smallest(may.filter(F.col("label") == y), MINED_ROWS) for y in (0, 1)]
    mined = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * MINED_ROWS ids
    stems = learn_stems(docs.join(mined, "id").select("text", "label"))
    votes = cast_votes(docs, stems).withColumnRenamed("votes", "_own")
    said = F.when(F.col("label") == 1, TOXIC).when(F.col("label") == 0, CLEAN).otherwise(ABSTAIN).cast("long")
    voted = cut_lineage(votes.join(may, "id", "left").select("id", "tag", (F.col("_own") + F.call_function("shiftleft", said, F.lit(2 * ANNOTATOR))).alias("votes")))
    patterns = cut_lineage(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))
    model = fit_label_model(patterns)

    def judge(batches):
        for batch in batches:
            yield {"votes": batch.column(0), "posterior": model.posterior(unpack_votes(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))), "n": batch.column(1)}

    judged = cut_lineage(over_batches(patterns, judge, "votes long, posterior double, n long"))
    learners = docs.filter("_learn AND id IS NOT NULL").select("id").distinct()
    rows = voted.join(learners, "id").join(judged.select("votes", "posterior"), "votes").groupBy("id", "tag").agg(F.max("posterior").alias("posterior"))
    rows = cut_lineage(rows)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("posterior") >= 0.5).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [
        _smallest(rows.filter((F.col("posterior") >= 0.5) == toxic), FITTED_ROWS).withColumn("weight", F.lit(sizes.get(toxic, 0) / max(1, min(FITTED_ROWS, sizes.get(toxic, 0)))))
        for toxic in (False, True)
    ]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * FITTED_ROWS rows of three numbers
    fitted = docs.withColumn("tag", F.xxhash64("text")).join(chosen, ["id", "tag"]).select("text", "posterior", "weight")
    return fit_classifier(fitted, stems), model


def score_toxicity(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text.

    Null and empty texts, and texts without a word, score as no evidence; repeated rows and null ids give one row each; an
    empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most STEMS stems and BUCKETS weights

    def work(batches):
        reader = shared.value.reader()
        for batch in batches:
            yield {"id": batch.column(0), "score": [shared.value.score(reader, t) for t in batch.column(1).to_pylist()]}

    kind = docs.schema[id_col].dataType.simpleString()
    return over_batches(docs.select(F.col(id_col), F.col(text_col)), work, f"id {kind}, score double").withColumnRenamed("id", id_col)
