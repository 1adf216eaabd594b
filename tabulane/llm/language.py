"""Language by rank-order profiles: a text's most frequent n-grams against each language's, by out-of-place distance."""

from __future__ import annotations

import sys
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulane.llm.common import over_batches

PROFILE = 400  # ranked n-grams of a language, and of a text
SLICE = 1 << 20  # characters counted at once
KEPT = 400_000  # n-grams a task gathers before it passes its counts on
UNKNOWN = "und"


class Profiles(NamedTuple):
    """Learned languages in order; the n-grams of all of them, sorted; ranks[i, l]: place of gram i in language l, PROFILE if absent."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _symbols(text: str) -> np.ndarray:
    """Lower-case letters as numbers from 2 on; every run of other characters, and both ends, as one 1."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    marks = np.where(_letters()[codes], codes.astype(np.int64) + 2, 1)
    keep = marks > 1
    keep[1:] |= marks[:-1] > 1
    keep[0] = True
    return marks[keep]


def _grams(s: np.ndarray) -> np.ndarray:
    """All n-grams of 1 to 3 symbols as numbers, without those that span words."""
    two = s[:-1] << 21 | s[1:]
    three = (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[s[1:-1] > 1]
    return np.concatenate([s[s > 1], two, three])


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams.sort()
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[starts], np.diff(np.append(starts, len(grams)))


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller number."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from every row with a language and a text.

    Counts are combined in each task, then per (language, n-gram); only `size` rows per language reach the driver.
    """

    def work(batches):
        held: dict[str, list] = {}

        def emit():
            for lang, parts in held.items():
                grams, counts = merged(parts)
                yield {"lang": [lang] * len(grams), "gram": grams, "n": counts}
            held.clear()

        def merged(parts):
            grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            waiting: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, len(text), SLICE):
                    waiting.setdefault(lang, []).append(text[at : at + SLICE])
            for lang, texts in waiting.items():
                group, length = [], 0
                for k, text in enumerate(texts):
                    group.append(text)
                    length += len(text)
                    if length >= SLICE or k + 1 == len(texts):
                        grams, counts = _counted(_grams(_symbols("\n".join(group))))
                        parts = held.setdefault(lang, [])
                        parts.append((grams, counts))
                        if len(parts) > 16:
                            held[lang] = [merged(parts)]
                        group, length = [], 0
            if sum(len(p[0]) for parts in held.values() for p in parts) > KEPT:
                yield from emit()
        yield from emit()

    known = docs.select(F.col(text_col), F.col(lang_col)).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = over_batches(known, work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the mark between words alone is no n-gram of a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram")))
    rows = counts.withColumn("place", place).filter(F.col("place") <= size).collect()
    langs = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], dtype=np.int64))
    ranks = np.full((len(grams), len(langs)), size, dtype=np.int64)
    for r in rows:
        ranks[np.searchsorted(grams, r["gram"]), langs.index(r["lang"])] = r["place"] - 1
    return Profiles(langs, grams, ranks, size)


def classify(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """The nearest language (ties to the first by name) and how near it is: 1 for the same profile, 0 for nothing in common."""
    symbols = _symbols(text or "")
    if len(profiles.langs) == 0 or not (symbols > 1).any():
        return UNKNOWN, 0.0
    own = _top(*_counted(_grams(symbols)), profiles.size)
    at = np.minimum(np.searchsorted(profiles.grams, own), len(profiles.grams) - 1)
    ranks = np.where((profiles.grams[at] == own)[:, None], profiles.ranks[at], profiles.size)
    places = np.arange(len(own))[:, None]
    apart = np.where(ranks == profiles.size, profiles.size, np.abs(ranks - places)).sum(axis=0)
    best = int(np.argmin(apart))
    return profiles.langs[best], float(1 - apart[best] / (profiles.size * len(own)))


def detect_language(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text.

    Null texts, texts without a letter, and every text when nothing was learned: "und" and 0. Repeated rows and null ids
    give one row each; an empty table gives none; other columns are not read.
    """

    def work(batches):
        for batch in batches:
            found = [classify(t, profiles) for t in batch.column(1).to_pylist()]
            yield {"id": batch.column(0), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    kind = docs.schema[id_col].dataType.simpleString()
    out = over_batches(docs.select(F.col(id_col), F.col(text_col)), work, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
