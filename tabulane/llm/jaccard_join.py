"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, each pair verified once.

The shingles of a document are 64-bit hashes made of the hashes of their words, its class is a cryptographic hash of all words. They travel packed in blobs, first by shingle, to learn in how many
different texts each occurs, then back by text. Only shingles of two or more texts come back, so a text whose rare ones
already fill its prefix is out at once, and an intersection can be counted from what came back alone.
Texts with the same words are one class; classes, not documents, are joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.llm.common import as_bytes, mix64, over_batches, partitions
from tabulane.llm.components import connected_components
from tabulane.operators.skew import dimension_join
from tabulane.session import cut_lineage

WORDS = 5
PERCENT = 75
SEEN = 1_000_000  # classes a task remembers to have sent; it may send one again beyond that
SAMPLE = 4000  # texts in which very frequent shingles are looked for; they only take another way, with the same result
ROWS = 2000  # texts a task cuts into shingles at once
HOT = 0.01  # share of the sample from which a shingle counts as very frequent
HOT_RANK = 1 << 30  # very frequent shingles come after all others
CENTRES = 8  # classes that a further round of stars tries in every shingle
OPEN_PAIRS = 32  # pairs a row between components that are not connected; beyond that, further stars come first
GAIN = 0.25  # they end when a round leaves more than this share of the pairs

_STEP = np.uint64(0x9E3779B97F4A7C15)
_RUN = np.dtype([("cls", "u8"), ("size", "u4"), ("n", "u4")])
_ITEM = np.dtype([("h", "u8"), ("df", "u4")])


def shingle_set(text: bytes, words: int = WORDS) -> tuple[int, np.ndarray]:
    """(class, sorted distinct shingle hashes); the class is a hash of all words. Without words: (0, none)."""
    found = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not found:
        return 0, np.zeros(0, dtype=np.uint64)
    whole = int.from_bytes(hashlib.blake2b(b" ".join(found), digest_size=8).digest(), "little")
    if len(found) < words:
        return whole, np.array([whole], dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - words + 1
    shingles = np.zeros(n, dtype=np.uint64)
    for i in range(words):  # the order of words counts: each step spreads what the earlier words gave
        shingles = mix64(shingles * _STEP + hashed[i : i + n])
    return whole, np.unique(shingles)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _groups(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys in a sorted array, both ends included."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _pack(part: np.ndarray, cls: np.ndarray, size: np.ndarray, items: np.ndarray, parts: int):
    """Blobs (part, runs, items) of rows that are in runs of one class."""
    small = part.astype(np.uint16 if parts < 1 << 16 else np.uint32)
    order = np.argsort(small, kind="stable")
    bounds = np.searchsorted(small[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        rows = order[bounds[k] : bounds[k + 1]]
        cuts = _groups(cls[rows])
        runs = np.empty(len(cuts) - 1, dtype=_RUN)
        runs["cls"], runs["size"], runs["n"] = cls[rows[cuts[:-1]]], size[rows[cuts[:-1]]], np.diff(cuts)
        yield int(k), runs.tobytes(), items[rows].tobytes()


def _unpack(blobs: pd.DataFrame, item: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, size, item) of every row of some blobs."""
    runs = np.frombuffer(b"".join(blobs["runs"]), dtype=_RUN)
    items = np.frombuffer(b"".join(blobs["items"]), dtype=item)
    return np.repeat(runs["cls"], runs["n"]), np.repeat(runs["size"], runs["n"]), items


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def document_classes(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, tag, n_shingles, cls); tag is a hash of the text, cls is null for a text without words."""

    def work(batches):
        for batch in _slices(batches):
            found = [(cls, len(shingles)) for cls, shingles in (shingle_set(t, words) for t in as_bytes(batch.column(1)))]
            yield {
                "id": batch.column(0),
                "tag": batch.column(2),
                "n_shingles": [n for _, n in found],
                "cls": [_signed(c) if n else None for c, n in found],
            }

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(text_col)))
    return over_batches(read, work, f"id {kind}, tag long, n_shingles long, cls long")


def _frequent(docs: DataFrame, id_col: str, text_col: str, words: int, n: int) -> np.ndarray:
    """Hashes of the shingles in more than HOT of a sample of about SAMPLE documents; at most 1/HOT times a text's length."""

    def work(batches):
        for batch in batches:
            for cls, shingles in (shingle_set(t, words) for t in as_bytes(batch.column(0))):
                yield {"cls": np.full(len(shingles), cls, dtype=np.uint64).view(np.int64), "h": shingles.view(np.int64)}

    every = max(1, n // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(every)) == 0).select(F.col(text_col))
    counts = over_batches(sample, work, "cls long, h long").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    least = max(8.0, HOT * min(n, SAMPLE))
    rows = counts.filter(F.col("n") >= least).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64))


def shared_shingles(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, n: int) -> DataFrame:
    """(cls, size, shared, elements, prefix) of the classes that can have a partner.

    `elements`: the shingles that other classes have too, rarest first, packed; `shared` their number; `prefix`: those of them
    that lie within the first size - ceil(percent% of size) + 1 of all shingles, rarest first.
    """
    parts = partitions(docs.sparkSession)
    hot = _frequent(docs, id_col, text_col, words, n)

    def pack(batches):
        seen: set[int] = set()
        for batch in _slices(batches):
            classes, sets = [], []
            for cls, shingles in (shingle_set(t, words) for t in as_bytes(batch.column(0))):
                if len(shingles) and cls not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(cls)
                    classes.append(cls)
                    sets.append(shingles)
            if not sets:
                continue
            sizes = np.array([len(s) for s in sets], dtype=np.uint32)
            h = np.concatenate(sets)
            cls, size = np.repeat(np.array(classes, dtype=np.uint64), sizes), np.repeat(sizes, sizes)
            frequent = np.isin(h, hot) if len(hot) else np.zeros(len(h), dtype=bool)
            for direct in (False, True):
                pick = np.flatnonzero(frequent == direct)
                to = (cls if direct else h)[pick]
                for part, runs, items in _pack((to >> np.uint64(24)) % np.uint64(parts), cls[pick], size[pick], h[pick], parts):
                    yield {"part": [part], "direct": [direct], "runs": [runs], "items": [items]}

    def share(blobs: pd.DataFrame) -> pd.DataFrame:
        """Shingles of two or more classes, sent to their class. Very frequent ones arrive by class and are passed on."""
        out = []
        for direct in (False, True):
            cls, size, h = _unpack(blobs[blobs["direct"] == direct], np.dtype("u8"))
            if not len(h):
                continue
            order = np.lexsort((cls, h))
            cls, size, h = cls[order], size[order], h[order]
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
            cls, size, h = cls[first], size[first], h[first]
            if direct:
                df = np.full(len(h), HOT_RANK, dtype=np.int64)
            else:
                counts = np.diff(_groups(h))
                df = np.repeat(counts, counts)
            pick = np.flatnonzero(df >= 2)
            pick = pick[np.argsort(cls[pick], kind="stable")]
            items = np.empty(len(pick), dtype=_ITEM)
            items["h"], items["df"] = h[pick], df[pick]
            out += _pack((cls[pick] >> np.uint64(24)) % np.uint64(parts), cls[pick], size[pick], items, parts)
        return pd.DataFrame(out, columns=["part", "runs", "items"])

    def assemble(blobs: pd.DataFrame) -> pd.DataFrame:
        cls, size, items = _unpack(blobs, _ITEM)
        order = np.lexsort((items["h"], items["df"], cls))
        cls, size, items = cls[order], size[order], items[order]
        out, cuts = [], _groups(cls)
        for a, b in zip(cuts[:-1], cuts[1:]):
            n, shared = int(size[a]), int(b - a)
            least = -(-percent * n // 100)
            if shared >= least:
                h = np.ascontiguousarray(items["h"][a:b])
                within = n - least + 1 - (n - shared)
                out.append((_signed(int(cls[a])), n, shared, h.tobytes(), h[:within].view(np.int64).tolist()))
        return pd.DataFrame(out, columns=["cls", "size", "shared", "elements", "prefix"])

    packed = over_batches(docs.select(F.col(text_col)), pack, "part int, direct boolean, runs binary, items binary")
    back = packed.groupBy("part").applyInPandas(share, "part int, runs binary, items binary")
    return back.groupBy("part").applyInPandas(assemble, "cls long, size int, shared int, elements binary, prefix array<bigint>")


def _apart(x: np.ndarray, y: np.ndarray, limit: int, depth: int) -> int:
    """A lower bound of the number of elements in one of two sorted arrays only, from how medians split them."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    at = len(y) // 2
    cut = int(np.searchsorted(x, y[at]))
    hit = int(cut < len(x) and x[cut] == y[at])
    left, right = abs(cut - at), abs(len(x) - cut - hit - (len(y) - at - 1))
    if left + right + 1 - hit > limit:
        return left + right + 1 - hit
    left = _apart(x[:cut], y[:at], limit - right, depth - 1)
    return left + (1 - hit) + _apart(x[cut + hit :], y[at + 1 :], limit - left, depth - 1)


def linked(x: np.ndarray, y: np.ndarray, size_x: int, size_y: int, percent: int) -> bool:
    """Whether two texts reach the similarity, from their sorted shared shingles: suffix filter, then the exact count."""
    need = -(-percent * (size_x + size_y) // (100 + percent))
    allowed = len(x) + len(y) - 2 * need
    if allowed < 0 or _apart(x, y, allowed, 2) > allowed:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (size_x + size_y - both)


def _verify(pairs: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked."""

    def work(batches):
        for batch in batches:
            a, b, sa, sb, ea, eb = (batch.column(c).to_pylist() for c in ("a", "b", "size_a", "size_b", "ea", "eb"))
            good = [
                i for i in range(len(a)) if linked(np.sort(np.frombuffer(ea[i], "u8")), np.sort(np.frombuffer(eb[i], "u8")), sa[i], sb[i], percent)
            ]
            yield {"a": [a[i] for i in good], "b": [b[i] for i in good]}

    left = kept.select(F.col("cls").alias("a"), F.col("size").alias("size_a"), F.col("elements").alias("ea"))
    right = kept.select(F.col("cls").alias("b"), F.col("size").alias("size_b"), F.col("elements").alias("eb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "ea", "eb")
    return over_batches(both, work, "a long, b long")


def _possible(percent: int) -> str:
    """Length and positional filter on rows x and y that meet in a shingle: what is left from there on has to suffice."""
    return (
        f"100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size) AND "
        f"{100 + percent} * least(x.shared - x.at, y.shared - y.at) >= {percent} * (x.size + y.size)"
    )


def _stars(rows: DataFrame, others: DataFrame, orders: list[Column], percent: int) -> DataFrame:
    """Candidates (a, b) of each class of `others`, one per order: of the classes that come first in a shingle, the one it meets in most shingles."""
    first = [F.min(F.struct(order.alias("order"), "cls", "size", "shared", "at", "label")) for order in orders]
    centre = rows.groupBy("h").agg(F.array(*first).alias("all")).select(F.col("h").alias("h2"), F.posexplode("all").alias("i", "c")).select("h2", "i", "c.*")
    met = others.alias("x").join(centre.alias("y"), F.expr(f"x.h = y.h2 AND x.cls != y.cls AND x.label != y.label AND {_possible(percent)}"))
    counted = met.groupBy(F.col("x.cls").alias("b"), "i", F.col("y.cls").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("b", "i").agg(F.max(F.struct("n", "a")).alias("top")).select("b", F.col("top.a").alias("a")).distinct()


def _open(prefixes: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, float]:
    """(rows, their number, pairs): prefix rows of the shingles that several components hold; `main` is the component with most rows of the shingle.

    `pairs` is how often rows of two components meet, before any filter.
    """
    rows = _labelled(prefixes, labels)
    held = rows.groupBy("h", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
    several = held.groupBy("h").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), pairs.alias("pairs")).filter("pairs > 0")
    several = several.select("h", F.col("most.label").alias("main"), (F.col("pairs") / F.col("n")).alias("meets"))
    rows = cut_lineage(rows.join(several, "h").select("h", "cls", "label", "main", "meets", "size", "shared", "at"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("meets").alias("pairs")).first()
    return rows, found["n"], found["pairs"] or 0.0


def _labelled(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    known = prefixes.join(labels.select(F.col("node").alias("cls"), F.col("component").alias("label")), "cls", "left")
    return known.withColumn("label", F.coalesce("label", "cls"))


_PAIR = np.dtype([("a", "u8"), ("b", "u8"), ("n", "u4"), ("left", "u4"), ("sizes", "u4")])


def _combined(pairs: np.ndarray) -> np.ndarray:
    """One row per pair: its meetings counted, what is left after the last of them."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    start = np.flatnonzero(np.concatenate([[True], (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])]))
    out = pairs[start].copy()
    out["n"], out["left"] = np.add.reduceat(pairs["n"], start), np.minimum.reduceat(pairs["left"], start)
    return out


def _home(cls: np.ndarray, parts: int) -> np.ndarray:
    return (cls >> np.uint64(24)) % np.uint64(parts)


def _meetings(percent: int, parts: int):
    """Pairs of different components that meet in a shingle and pass length and positional filter, packed by their first class."""

    def of_one(g: dict[str, np.ndarray]) -> list[np.ndarray]:
        out = []
        order = np.lexsort((g["cls"], g["label"], g["members"]))  # the largest component last
        g = {k: v[order] for k, v in g.items()}
        rest = g["shared"] - g["at"]
        for i in np.flatnonzero(g["label"] != g["label"][-1]):
            size = g["size"][i + 1 :]
            fits = 100 * np.minimum(size, g["size"][i]) >= percent * np.maximum(size, g["size"][i])
            left = np.minimum(rest[i + 1 :], rest[i])
            fits &= (100 + percent) * left >= percent * (size + g["size"][i])
            near = np.flatnonzero(fits & (g["label"][i + 1 :] != g["label"][i]))
            if len(near):
                pairs = np.empty(len(near), dtype=_PAIR)
                pairs["a"], pairs["b"] = g["cls"][i : i + 1].view(np.uint64)[0], g["cls"][i + 1 :][near].view(np.uint64)
                pairs["n"], pairs["left"], pairs["sizes"] = 1, left[near], size[near] + g["size"][i]
                out.append(pairs)
        return out

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        g = {c: rows[c].to_numpy(np.int64) for c in ("h", "cls", "label", "members", "size", "shared", "at")}
        order = np.argsort(g["h"], kind="stable")
        g = {k: v[order] for k, v in g.items()}
        cuts = _groups(g.pop("h"))
        found, waiting, held = np.zeros(0, dtype=_PAIR), [], 0
        for start, end in zip(cuts[:-1], cuts[1:]):
            new = of_one({k: v[start:end] for k, v in g.items()})
            waiting += new
            held += sum(map(len, new))
            if held > 1_000_000:
                found, waiting, held = _combined(np.concatenate([found, *waiting])), [], 0
        found = _combined(np.concatenate([found, *waiting]))
        home = _home(found["a"], parts)
        out = [(int(p), found[home == p].tobytes()) for p in np.unique(home)]
        return pd.DataFrame(out, columns=["part", "pairs"])

    return work


def _first_sides(percent: int, parts: int):
    """Pairs with the shingles of their first class, sent to the part of the second; a class is sent once to a part, not once per pair."""

    def work(blobs: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        pairs = _combined(np.frombuffer(b"".join(blobs["pairs"]), dtype=_PAIR))
        # with all common prefix shingles counted, what follows the last of them has to bring the rest
        pairs = pairs[(100 + percent) * (pairs["n"].astype(np.int64) + pairs["left"] - 1) >= percent * pairs["sizes"].astype(np.int64)]
        known = {int(c) & (2**64 - 1): row for c, *row in zip(kept["cls"], kept["label"], kept["size"], kept["elements"])}
        home, out = _home(pairs["b"], parts), []
        for part in np.unique(home):
            own = pairs[home == part]
            for a in np.unique(own["a"]):
                out.append((int(part), *known[int(a)], own["b"][own["a"] == a].tobytes()))
        return pd.DataFrame(out, columns=["part", "label", "size", "elements", "partners"])

    return work


def _second_sides(percent: int):
    """Links between the components of verified pairs; a pair whose components the links of this task connect already is passed over."""

    def work(asked: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        known = {int(c) & (2**64 - 1): row for c, *row in zip(kept["cls"], kept["label"], kept["size"], kept["elements"])}
        sets, above, out = {}, {}, []

        def top(label: int) -> int:
            while label in above:
                above[label] = above.get(above[label], above[label])
                label = above[label]
            return label

        for label, size, elements, partners in zip(asked["label"], asked["size"], asked["elements"], asked["partners"]):
            x = np.sort(np.frombuffer(elements, "u8"))
            for b in np.frombuffer(partners, "u8").tolist():
                other, size_b, elements_b = known[b]
                one, two = top(label), top(other)
                if one == two:
                    continue
                if b not in sets:
                    sets[b] = np.sort(np.frombuffer(elements_b, "u8"))
                if linked(x, sets[b], size, size_b, percent):
                    above[one] = two
                    out.append((label, other))
        return pd.DataFrame(out, columns=["a", "b"])

    return work


def _remaining(rows: DataFrame, labels: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """The links between components that are not connected yet: every possible pair verified at most once, pairs and sets packed.

    `rows` as _open gives them. Each task returns links between components that join no circle, so their number does not grow with that of the pairs.
    """
    parts = partitions(kept.sparkSession)
    members = labels.groupBy("component").agg(F.count(F.lit(1)).alias("members")).withColumnRenamed("component", "label")
    sized = rows.drop("main", "meets").join(members, "label", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int"))
    pairs = dealt.groupBy("part").applyInPandas(_meetings(percent, parts), "part int, pairs binary")
    home = F.pmod(F.shiftrightunsigned("cls", 24), F.lit(parts)).cast("int").alias("part")
    open_ = kept.join(rows.select("cls", "label").distinct(), "cls").select(home, "cls", "label", "size", "elements")
    first = pairs.groupBy("part").cogroup(open_.groupBy("part")).applyInPandas(
        _first_sides(percent, parts), "part int, label long, size int, elements binary, partners binary"
    )
    return first.groupBy("part").cogroup(open_.groupBy("part")).applyInPandas(_second_sides(percent), "a long, b long")


def linked_classes(kept: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect all that similar pairs connect.

    A first round links every class to two centres it shares much with, so large groups of near copies become one component with
    some checks a member. While many pairs are not connected, and far fewer after each round, further rounds try other centres.
    Then every pair that meets in a prefix shingle, passes the filters and is not yet connected is verified: a pair that is left
    out is connected already.
    """
    prefixes = kept.select("cls", "size", "shared", F.posexplode("prefix").alias("at", "h"))
    single = prefixes.withColumn("label", F.col("cls"))
    links = cut_lineage(_verify(_stars(single, single, [F.col("cls"), F.bitwise_not("cls")], percent), kept, percent))
    labels = connected_components(links)
    rows, n, pairs = _open(prefixes, labels)
    turn, before = 0, float("inf")
    while pairs > OPEN_PAIRS * n and pairs <= GAIN * before:
        orders = [F.xxhash64("cls", F.lit(turn * CENTRES + i)) for i in range(CENTRES)]
        star = cut_lineage(_verify(_stars(rows, rows.filter("label != main"), orders, percent), kept, percent))
        links = links.unionByName(star)
        labels = connected_components(links)
        turn, before = turn + 1, pairs
        rows, n, pairs = _open(prefixes, labels)
    return links.unionByName(_remaining(rows, labels, kept, percent))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes of all rows, and (cls, component, component_id) of the classes that stand on more than one row or are linked."""
    classes = cut_lineage(document_classes(docs, id_col, text_col, words))
    n = classes.count()
    kept = cut_lineage(shared_shingles(docs, id_col, text_col, words, percent, n))
    labels = connected_components(linked_classes(kept, percent))
    groups = classes.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    known = groups.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    several = known.filter((F.col("n") > 1) | F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "cls"))
    least = several.groupBy("component").agg(F.min("least").alias("component_id"))
    return classes, cut_lineage(several.join(least, "component").select("cls", "component", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id reachable by links of Jaccard similarity >= percent%.

    A text's set: its distinct shingles of `words` words; with fewer words the whole as one. Null texts and texts without words have
    no set and no link: they are their own component. Rows of one id are linked only through their texts; rows with a null
    id take the smallest known id of their component (null if there is none). An empty table gives none; other columns are not read.
    """
    classes, found = _grouped(docs, id_col, text_col, words, percent)
    joined = dimension_join(classes, found.drop("component"), ["cls"], "left")
    return joined.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each group that links of Jaccard similarity >= percent% connect: that of the smallest id, then text hash.

    Groups are of texts, not of ids: of rows with one id and unrelated texts all stay. A null id comes after all others. Of rows equal
    in id and text one stays, the smallest as JSON; texts without words (null and empty ones) are in no group and all stay.
    An empty table gives none. Columns named _leader_id or _leader_tag are not allowed.
    """
    classes, found = _grouped(docs, id_col, text_col, words, percent)
    members = dimension_join(classes.filter(F.col("cls").isNotNull()), found.drop("component_id"), ["cls"])
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("tag").alias("tag"))
    members = cut_lineage(members.select("component", place.alias("place")))
    rows = members.groupBy("component", "place").agg(F.count(F.lit(1)).alias("n"))  # all rows of a place share their text
    first = members.groupBy("component").agg(F.min("place").alias("first"))
    rows = cut_lineage(rows.join(first, "component").select(F.col("place.*"), "n", (F.col("place") == F.col("first")).alias("leads")))
    named = docs.select("*", F.col(id_col).alias("_leader_id"), F.xxhash64(F.col(text_col)).alias("_leader_tag"))

    def same(places: DataFrame) -> Column:
        return named["_leader_id"].eqNullSafe(places["id"]) & (named["_leader_tag"] == places["tag"])

    others = rows.filter(~F.col("leads")).select("id", "tag")
    left = named.join(others, same(others), "left_anti")
    twice = rows.filter(F.col("leads") & (F.col("n") > 1)).select("id", "tag")
    if not twice.isEmpty():
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        copies = named.join(twice, same(twice), "left_semi").groupBy("_leader_id", "_leader_tag").agg(F.min_by(whole, F.to_json(whole)).alias("row"))
        once = left.join(twice, (F.col("_leader_id").eqNullSafe(twice["id"])) & (F.col("_leader_tag") == twice["tag"]), "left_anti")
        return once.select(*docs.columns).unionByName(copies.select("row.*"))
    return left.select(*docs.columns)
