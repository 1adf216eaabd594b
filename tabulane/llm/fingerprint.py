"""Homomorphic multiset hash of a text's pieces: wide vectors added modulo powers of two.

Pieces are the paragraphs of a text and, within each, its runs of two words or four characters, so that an edit inside a
paragraph leaves the runs it does not touch. The vector of a piece has 45 numbers: its count (1), four residues of 32 random bits, and 40 numbers that each hold three
one-bit lanes, 20 bits apart. Vectors add modulo 2^60, so the order of paragraphs does not matter and paragraphs
can be put in or taken out. The residues serve equality; the one-bit lanes are a random projection, so the squared
length of a difference estimates how many pieces differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.operators.ranking import with_rank
from tabulane.session import cut_lineage

PARAGRAPH = "\\n|(?<=[.!?]) |(?<=[。！？।॥۔؟։።]) ?"  # lines, and sentences within them
# A text up to the last of its cuts that holds whatever follows the text.
_CLOSED = r"(?s)^.*(?:\n|(?<=[.!?]) |(?<=[。！？।॥۔؟։።])(?: |(?=[^ ])))"
_UNSPACED = r"\u0e00-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef\x{20000}-\x{3ffff}"  # scripts that set no spaces between words
_WORD = rf"(?<!\S)[^\s{_UNSPACED}]{{1,24}}(?!\S)"
_NOT_WORDS = rf"[{_UNSPACED}]|\S{{25}}"
# From each word two tokens, from each other character (unspaced scripts, longer strings) four of them; group 1 is empty where too few follow.
RUN = rf"(?:(?=({_WORD}\s*(?:{_WORD}|\S)|(?!{_WORD})\S(?:\s*\S){{3}})))?(?:{_WORD}|\S)"
SIZE = 45
HEAD = 5  # count and residues, before the lanes
_MASK = (1 << 60) - 1
_LANES = 1 | 1 << 20 | 1 << 40
_LANE = (1 << 20) - 1
_LOW = (1 << 32) - 1
_PART = 20  # so many bits of a piece's place are added up in one row: sums of 60-bit lanes stay below 2^61


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def zero() -> Column:
    """The vector of no pieces."""
    return F.array_repeat(_long(0), SIZE)


def _numbers(words: list[Column]) -> list[Column]:
    """The 45 numbers of a piece from its four hash words."""
    a, b, c, d = words
    head = [_long(1), a.bitwiseAND(_long(_LOW)), F.shiftrightunsigned(a, 32), b.bitwiseAND(_long(_LOW)), F.shiftrightunsigned(b, 32)]
    return head + [F.shiftrightunsigned(w, i).bitwiseAND(_long(_LANES)) for w in (c, d) for i in range(20)]


def _hashes(piece: Column) -> list[Column]:
    """Two hashes that do not follow from each other: the second starts from another seed."""
    return [F.xxhash64(piece), F.xxhash64(F.lit(1), piece)]


def _words(a: Column, b: Column) -> list[Column]:
    """The hash words of a piece: its two hashes, and two more of both."""
    return [a, b, F.xxhash64(a, b), F.xxhash64(b, a)]


def _pairs(words: Column) -> Column:
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def _runs(paragraph: Column) -> Column:
    """Runs within a paragraph, but for the paragraph itself. Where it is all words, splitting it is much faster than `RUN`."""
    words = F.filter(F.split(paragraph, r"\s+"), lambda w: w != "")
    runs = F.when(paragraph.rlike(_NOT_WORDS), F.regexp_extract_all(paragraph, F.lit(RUN), F.lit(1))).otherwise(F.flatten(F.transform(F.array(words), _pairs)))
    return F.filter(runs, lambda r: (r != "") & (r != paragraph))


def _repeats(runs: Column) -> Column:
    """Of sorted runs, each once for each doubling of its count, marked by the level."""

    def level(j: Column) -> Column:
        doubled = F.filter(runs, lambda r, i: F.get(runs, i + F.call_function("shiftleft", F.lit(1), j) - 1) == r)
        return F.transform(F.array_distinct(doubled), lambda r: F.concat(r, F.lit("\n"), j.cast("string")))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.floor(F.log2(F.size(runs))).cast("int")), level))


def _damped(runs: Column) -> Column:
    """Each run once, and once more for each doubling of its count within the paragraph."""
    once = F.array_distinct(runs)
    return F.when(F.size(once) == F.size(runs), runs).otherwise(F.concat(once, F.flatten(F.transform(F.array(F.sort_array(runs)), _repeats))))


def pieces(text: Column, pattern: str = PARAGRAPH) -> Column:
    """The pieces of a text: its paragraphs, and what `_damped` leaves of the runs within each. Those of two texts joined by a line end are those of both."""
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda p: p != "")
    return F.concat(paragraphs, F.flatten(F.transform(F.transform(paragraphs, _runs), _damped)))


def closed_head(text: Column) -> Column:
    """The longest beginning of a text that ends with a cut, so that its pieces and those of any rest together are those of the whole; empty if there is no cut."""
    return F.regexp_extract(text, _CLOSED, 0)


def add(a: Column, b: Column) -> Column:
    """Vector of both multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(_long(_MASK)))


def remove(a: Column, b: Column) -> Column:
    """Vector of `a` without the pieces of `b`."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(_long(_MASK)))


def fingerprint(text: Column, pattern: str = PARAGRAPH) -> Column:
    """Vector of a text; null and empty texts have the zero vector."""
    hashes = F.transform(pieces(text, pattern), lambda p: F.array(*_hashes(p)))
    words = F.transform(hashes, lambda h: F.array(*_words(h[0], h[1])))
    return F.aggregate(words, zero(), lambda sum_, w: add(sum_, F.array(*_numbers([w[i] for i in range(4)]))))


def with_fingerprints(table: DataFrame, keys: list[str], texts: dict[str, Column]) -> DataFrame:
    """`keys`, which tell the rows apart, and the `fingerprint` of each text under its name.

    Pieces become rows and are added up by generated code, many times faster than by the array functions of `fingerprint`. Nothing is
    shuffled where the table is already dealt out by some of the keys.
    """
    stacked = table.select(*keys, F.posexplode(F.array(*texts.values())).alias("_which", "_text"))
    cut = stacked.select(*keys, "_which", F.posexplode_outer(pieces(F.col("_text"))).alias("_at", "_piece"))
    known = F.col("_piece").isNotNull()
    part = F.shiftright(F.coalesce("_at", F.lit(0)), _PART).alias("_part")
    read = cut.select(*keys, "_which", part, *[F.when(known, w).alias(f"_{i}") for i, w in enumerate(_hashes(F.col("_piece")))])
    mixed = [F.when(F.col("_0").isNotNull(), w).alias(f"_{i}") for i, w in enumerate(_words(F.col("_0"), F.col("_1")))]
    hashed = read.select(*keys, "_which", "_part", *mixed)
    numbers = _numbers([F.col(f"_{i}") for i in range(4)])
    sums = hashed.groupBy(*keys, "_which", "_part").agg(F.count("_0").alias("n0"), *[F.sum(x).alias(f"n{i}") for i, x in enumerate(numbers) if i])
    vector = F.array(*[F.coalesce(F.col(f"n{i}"), _long(0)).bitwiseAND(_long(_MASK)) for i in range(SIZE)])
    parts = sums.select(*keys, "_which", vector.alias("_vector"))
    return parts.groupBy(*keys).agg(*[F.aggregate(F.collect_list(F.when(F.col("_which") == i, F.col("_vector"))), zero(), add).alias(name) for i, name in enumerate(texts)])


def as_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _signs(v: Column) -> Column:
    """The 120 lanes as sums of +1 or -1 per piece: 2 * ones - n. A lane keeps the ones modulo 2^20 and what lanes below carry over; the sum, far smaller than n, tells them."""
    n = v[0]

    def sign(x: Column) -> Column:
        return F.pmod(x * 2 - n + _LANE + 1, _long(2 * (_LANE + 1))) - (_LANE + 1)

    def carried(x: Column) -> Column:
        return F.shiftright(x - F.shiftright(n + sign(x), 1), 20)

    lowest = F.slice(v, HEAD + 1, SIZE - HEAD)
    middle = F.transform(lowest, carried)
    return F.concat(*[F.transform(x, sign) for x in (lowest, middle, F.transform(middle, carried))])


def _squared(signs: Column) -> Column:
    return F.aggregate(signs, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated likeness of two multisets, 0 to 1: 2 <a, b> / (<a, a> + <b, b>) of their piece counts; 1 for equal vectors."""

    def compared(x: Column, y: Column) -> Column:
        both = _squared(x) + _squared(y)
        return 1 - _squared(F.zip_with(x, y, lambda u, v: u - v)) / F.when(both > 0, both)

    # bound as lambda variables, so that each is computed once
    rough = F.transform(F.array(F.transform(F.array(a, b), _signs)), lambda s: compared(s[0], s[1]))[0]
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rough)), F.lit(0.0)))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document by descending
    id; after the last comes the first. Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty. A null id comes last. Rows of one id with different texts follow each other by the hash of
    the text; rows equal in id and text count as one document and each get its result. A lone document is its own next.
    Other columns are not read.

    Places are found by a distributed sort of ids; whole texts are shuffled once, by id, and only the beginning that the
    edit needs and the vector travel on to the document before. A text and its edited text share their pieces up to the
    last cut before the edit; these are added up once, and the two rests apart.
    """
    key = F.coalesce(F.concat(F.lit("+"), F.col(id_col).cast("string")), F.lit("-"))
    texts = docs.select(key.alias("key"), F.xxhash64(F.col(text_col)).alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    ids = texts.groupBy("key", "tag").agg(F.max("id").alias("id"), F.max(F.char_length("text")).alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ranked = with_rank(ids, [F.col("id").desc_nulls_last(), F.col("tag")], "place")
    sizes = ranked.agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("copies")).first()
    if not sizes["n"]:
        sizes = {"n": 1, "copies": 1}
    before = ranked.select(
        F.pmod(F.col("place") + 1, F.lit(sizes["n"])).alias("place"),
        F.col("key").alias("to_key"),
        F.col("tag").alias("to_tag"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("take"),
    )
    about = ranked.join(before, "place").select("key", "tag", "id", "copies", "to_key", "to_tag", "take")
    placed = texts.select("key", "tag", "text").join(about, ["key", "tag"])
    if sizes["copies"] > 1:
        placed = placed.dropDuplicates(["key", "tag"])
    to = [F.col("to_key").alias("key"), F.col("to_tag").alias("tag")]
    sent = placed.select(*to, F.substring("text", F.lit(1), F.col("take")).alias("piece"))
    n = F.char_length("text")
    about_text = ["key", "tag", "to_key", "to_tag", "id", "copies"]
    kept = F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 3)).cast("int"))
    cut = placed.join(sent, ["key", "tag"]).select(*about_text, "text", "piece", n.cast("long").alias("n_chars"), kept.alias("kept"), closed_head(kept).alias("head"))
    edited = cut.withColumn("edited_sha256", F.sha2(F.concat("kept", "piece"), 256))
    # vectors add up: the head that a text and its edited text share is cut into pieces once
    start = F.char_length("head") + 1
    whole = F.lit(2**31 - 1)
    texts_of = {
        "shared": F.col("head"),
        "own_rest": F.substring(F.col("text"), start, whole),
        "new_rest": F.concat(F.substring(F.col("kept"), start, whole), "piece"),
    }
    keys = [*about_text, "n_chars", "edited_sha256"]
    sums = with_fingerprints(edited, keys, texts_of)
    vectors = cut_lineage(sums.select(*keys, add(F.col("shared"), F.col("own_rest")).alias("own"), add(F.col("shared"), F.col("new_rest")).alias("other")))
    following = vectors.select(*to, F.col("own").alias("next"))
    found = vectors.join(following, ["key", "tag"]).select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        "copies",
    )
    if sizes["copies"] > 1:
        found = found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.drop("copies")
