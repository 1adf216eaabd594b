"""Alignment of two tokenizers over the same bytes, by merging their token ends in lockstep.

A byte-level BPE (A) and a sentencepiece model (B) cut space + text into tokens. One vector of pointers per side walks all
documents of a batch at once: each step compares the ends under all pointers, marks a link and a cut where they are equal, moves the
pointer that is behind (both on a link), and drops what is finished. Long documents walk in several lanes of the vector.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulane.llm.byte_bpe import BYTE_OF
from tabulane.llm.common import over_batches, partitions
from tabulane.session import cut_lineage

LANE = 1024  # bytes of text a lane of the state vector walks
BATCH_BYTES = 1 << 20  # text in one state vector; a longer document has its own
MEMO_CHUNKS = 500_000  # encoded chunks a task remembers; it forgets all of them beyond that
MEMO_IDS = 4_000_000  # or beyond so many ids
SLICE = 2_000
BLOCK_PAIRS = 2_000_000  # id pairs whose counts one task looks up
SALT_LINKS = 8_000_000  # links one task looks up, about

# A space next to other white space, or at an end: then the places of spaces alone do not tell where tokens can be cut.
_UNSAFE = regex.compile(r"^ | $| \s|[^\S ] ").search
_BYTE_PIECE = regex.compile(r"<0x([0-9A-F]{2})>").fullmatch


def piece_bytes(piece: str) -> bytes:
    """The bytes of a sentencepiece piece: U+2581 is a space, <0xHH> a byte."""
    byte = _BYTE_PIECE(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def entry_bytes(entry: str) -> bytes:
    """The bytes of a byte-level entry; an entry with other characters (a special token) is its UTF-8."""
    return bytes(BYTE_OF[c] for c in entry) if all(c in BYTE_OF for c in entry) else entry.encode()


class _Memo:
    """Token ids of chunks, one after the other in growing arrays."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.start = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.count = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def extend(self, chunks: list[str], sides: tuple[list, list]) -> None:
        for i, ids in enumerate(sides):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start[i] = np.concatenate([self.start[i], len(self.flat[i]) + np.cumsum(n) - n])
            self.count[i] = np.concatenate([self.count[i], n])
            self.flat[i] = np.concatenate([self.flat[i], np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))])
        first = len(self.at)
        self.at.update((c, first + k) for k, c in enumerate(chunks))

    def ids(self, side: int, rows: np.ndarray) -> np.ndarray:
        n = self.count[side][rows]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[side][rows] - (ends - n), n)
        return self.flat[side][places]


class PairCoder:
    """Encodes texts with both tokenizers. Where spaces are single, chunks between them are encoded once and remembered.

    That is exact: no token of either side crosses from one such chunk into the next, which is checked of the vocabularies. Any
    other text is encoded whole.
    """

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        told = json.loads(a)
        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [entry_bytes(e) for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        cut = told.get("pre_tokenizer") or {}
        plain = told.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.by_chunk = plain and not any("▁" in p.lstrip("▁") for p in pieces)
        self.memo = _Memo()

    def _both(self, texts: list[str]) -> tuple[list, list]:
        """Ids of both sides, `SLICE` texts at a time: the tokenizer's own results are many times larger than the ids."""
        a = [e.ids for i in range(0, len(texts), SLICE) for e in self.a.encode_batch_fast([" " + t for t in texts[i : i + SLICE]], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def _same(self, text: str, a, b) -> bool:
        whole = (" " + text).encode()
        return b"".join([self.a_bytes[i] for i in a]) == whole and b"".join([self.b_bytes[i] for i in b]) == whole

    def _learn(self, cut: list[list[str] | None]) -> None:
        """Encode the chunks not met before; those that B does not spell stay unknown (a byte-level side spells anything)."""
        chunks = set(chain.from_iterable(filter(None, cut)))
        new = list(chunks.difference(self.memo.at))
        if len(self.memo.at) + len(new) > MEMO_CHUNKS or len(self.memo.flat[0]) > MEMO_IDS:
            self.memo, new = _Memo(), list(chunks)
        if new:
            a, b = self._both(new)
            piece = self.b_bytes.__getitem__
            good = [k for k, (c, ids) in enumerate(zip(new, b)) if b"".join(map(piece, ids)) == b" " + c.encode()]
            if len(good) < len(new):
                new, a, b = ([side[k] for k in good] for side in (new, a, b))
            self.memo.extend(new, (a, b))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(ids of A, ids of B) of each text; None where a side does not spell space + text."""
        cut = [t.split(" ") if self.by_chunk and not _UNSAFE(t) else None for t in texts]
        self._learn(cut)
        memo, out = self.memo, []
        for text, chunks in zip(texts, cut):
            rows = list(map(memo.at.get, chunks)) if chunks else [None]
            if None not in rows:
                places = np.array(rows)
                out.append((memo.ids(0, places), memo.ids(1, places)))
                continue
            (a,), (b,) = self._both([text])
            out.append((np.array(a, np.int32), np.array(b, np.int32)) if self._same(text, a, b) else None)
        return out


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each token of A the token of B that ends with it, or -1.

    Ends count bytes over all documents of the batch; `starts` are the documents' first bytes, `size` all bytes.
    """
    sizes = np.diff(np.append(starts, size))
    lanes = -(-sizes // LANE)
    first = np.repeat(starts, lanes)
    first = first + LANE * (np.arange(len(first)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    pa_, pb = np.searchsorted(ends_a, first, side="right"), np.searchsorted(ends_b, first, side="right")
    stop_a, stop_b = np.append(pa_[1:], len(ends_a)), np.append(pb[1:], len(ends_b))
    partner = np.full(len(ends_a), -1, np.int64)
    live = (pa_ < stop_a) & (pb < stop_b)
    while True:
        if not live.all():  # finished lanes leave the state
            pa_, pb, stop_a, stop_b = pa_[live], pb[live], stop_a[live], stop_b[live]
        if not len(pa_):
            return partner
        a, b = ends_a[pa_], ends_b[pb]
        link = a == b
        partner[pa_[link]] = pb[link]
        pa_, pb = pa_ + (a <= b), pb + (b <= a)
        live = (pa_ < stop_a) & (pb < stop_b)


class Aligned:
    """The alignment of the documents of one state vector: flat ids, marks and each document's places in them."""

    def __init__(self, coder: PairCoder, texts: list[str]):
        found = [None if not t else c for t, c in zip(texts, coder.encode(texts))]
        self.has = np.array([f is not None for f in found], bool)
        known = [f for f in found if f is not None]
        self.a = np.concatenate([f[0] for f in known]) if known else np.zeros(0, np.int32)
        self.b = np.concatenate([f[1] for f in known]) if known else np.zeros(0, np.int32)
        n_a = np.array([0 if f is None else len(f[0]) for f in found], np.int64)
        n_b = np.array([0 if f is None else len(f[1]) for f in found], np.int64)
        self.at_a, self.at_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        self.ends_a, self.ends_b = np.cumsum(coder.sizes[0][self.a]), np.cumsum(coder.sizes[1][self.b])
        self.first = np.concatenate([[0], self.ends_a])[self.at_a[:-1]]
        partner = lockstep(self.ends_a, self.ends_b, self.first[self.has], int(self.ends_a[-1]) if len(self.a) else 0)
        self.link_a = np.flatnonzero(partner >= 0)
        self.link_b = partner[self.link_a]
        self.at_link = np.searchsorted(self.link_a, self.at_a)

    def groups(self, words: dict[str, np.ndarray]) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each document, '' without tokens. `words` are the ids as text, each with what may follow."""
        n_a, n_b = len(self.a), len(self.b)
        cut_a, cut_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
        cut_a[self.link_a], cut_b[self.link_b] = True, True
        # a token stands behind the tokens of its side and those of the other side's earlier groups (for B: also of its own group)
        before_a = np.concatenate([[0], self.link_b + 1])[np.cumsum(cut_a) - cut_a]
        before_b = np.append(self.link_a + 1, n_a)[np.cumsum(cut_b) - cut_b]
        out = np.empty(n_a + n_b, object)
        out[np.arange(n_a) + before_a] = np.where(cut_a, words["a|"][self.a], words["a,"][self.a])
        out[np.arange(n_b) + before_b] = np.where(cut_b, words["b;"][self.b], words["b,"][self.b])
        ends = (self.at_a + self.at_b).tolist()
        flat = out.tolist()
        return ["".join(flat[s:e])[:-1] for s, e in zip(ends, ends[1:])]


def _words(coder: PairCoder) -> dict[str, np.ndarray]:
    def column(n, mark):
        return np.array([f"{i}{mark}" for i in range(n)], dtype=object)

    n_a, n_b = len(coder.a_bytes), len(coder.b_bytes)
    return {"a,": column(n_a, ","), "a|": column(n_a, "|"), "b,": column(n_b, ","), "b;": column(n_b, ";")}


def _vectors(batch: pa.RecordBatch):
    """Row ranges of a batch that go into one state vector each, with their texts; null reads as empty."""
    texts = batch.column(1)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate([*sizes, BATCH_BYTES + 1]):
        if i > start and size + n > BATCH_BYTES:
            yield start, i, [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += n


def _models(docs: DataFrame, a_path: str, b_path: str):
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))  # as large as the vocabularies


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, links array<struct<a,b>>, cuts array<long>): both sides' ids, the places of linked tokens, the byte offsets of space + text where groups end.

    Null and empty texts, and texts that a side does not spell, have empty arrays. Repeated rows and null ids give one row
    each; an empty table gives none; other columns are not read. A document has to fit a task.
    """
    models = _models(docs, a_path, b_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        coder = PairCoder(*models.value)
        for batch in batches:
            for start, end, texts in _vectors(batch):
                found = Aligned(coder, texts)
                ranges = [list(zip(x.tolist(), x[1:].tolist())) for x in (found.at_a, found.at_b, found.at_link)]
                yield {
                    "id": batch.column(0).slice(start, end - start),
                    "a_ids": [found.a[s:e] for s, e in ranges[0]],
                    "b_ids": [found.b[s:e] for s, e in ranges[1]],
                    "links": [
                        [{"a": x, "b": y} for x, y in zip((found.link_a[s:e] - found.at_a[i]).tolist(), (found.link_b[s:e] - found.at_b[i]).tolist())]
                        for i, (s, e) in enumerate(ranges[2])
                    ],
                    "cuts": [found.ends_a[found.link_a[s:e]] - found.first[i] for i, (s, e) in enumerate(ranges[2])],
                }

    fields = f"id {kind}, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>, cuts array<long>"
    return over_batches(docs.select(F.col(id_col), F.col(text_col)), work, fields).withColumnRenamed("id", id_col)


def _pack(pairs: np.ndarray) -> bytes:
    """Sorted pair numbers as differences, compressed."""
    return zstandard.compress(np.diff(pairs, prepend=0).astype("<u8" if len(pairs) and pairs[-1] >= 1 << 32 else "<u4").tobytes(), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.decompress(data)
    return np.cumsum(np.frombuffer(raw, "<u8" if n and len(raw) == 8 * n else "<u4").astype(np.int64))


def _digests(docs: DataFrame, models, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        coder = PairCoder(*models.value)
        words, width = _words(coder), len(coder.a_bytes)
        for batch in batches:
            for start, end, texts in _vectors(batch):
                found = Aligned(coder, texts)
                pairs = found.b[found.link_b].astype(np.int64) * width + found.a[found.link_a]
                n_links = np.diff(found.at_link)
                groups = found.groups(words)
                yield {
                    "id": batch.column(0).slice(start, end - start),
                    "n_a": np.diff(found.at_a),
                    "n_b": np.diff(found.at_b),
                    "n_groups": n_links,
                    "n_links": n_links,  # one token of each side at most ends at an offset
                    "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups],
                    "links": [_pack(np.sort(pairs[s:e])) for s, e in zip(found.at_link.tolist(), found.at_link[1:].tolist())],
                }

    fields = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
    return over_batches(docs.select(F.col(id_col), F.col(text_col)), work, fields)


def _pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): corpus-wide counts, added up within each task first."""

    def work(batches):
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found = [_unpack(d, n) for d, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            for i in range(0, len(found), 2000):
                some = [pairs, *found[i : i + 2000]]
                weights = np.concatenate([counts, np.ones(sum(map(len, some[1:])), np.int64)])
                pairs, at = np.unique(np.concatenate(some), return_inverse=True)
                counts = np.bincount(at, weights=weights, minlength=len(pairs)).astype(np.int64)
            if len(pairs) > BLOCK_PAIRS:
                yield {"pair": pairs, "n": counts}
                pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield {"pair": pairs, "n": counts}

    return over_batches(links.select("links", "n_links"), work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of the alignment of every whole text.

    The count of an id pair is the number of links between its two ids over all documents; n_best counts the document's links
    whose pair has the highest count among all pairs of its B id (ties included), count_sum adds up the counts of its links.

    Null and empty texts, and texts that a side does not spell, have zeros and an empty groups_sha256; repeated rows each
    count and give one row each, null ids too; an empty table gives none; other columns are not read.

    Texts are encoded once. What is kept of a document's links is their sorted pairs, compressed. Counts meet links in blocks of pairs,
    each repeated for as many salts as the number of links asks for, so neither the table of counts nor a frequent pair is one task's work.
    """
    spark = docs.sparkSession
    models = _models(docs, a_path, b_path)
    made = cut_lineage(_digests(docs, models, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    width = Tokenizer.from_str(models.value[0]).get_vocab_size(with_added_tokens=True)
    linked = made.filter("n_links > 0").select("row", "links", "n_links")
    counts = cut_lineage(_pair_counts(linked).withColumn("b", F.floor(F.col("pair") / width)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # as many rows as B has ids
    size = counts.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("links")).first()
    blocks = max(1, -(-size["pairs"] // BLOCK_PAIRS))
    salts = max(1, -(-(size["links"] or 0) // (SALT_LINKS * blocks)))
    parts = max(partitions(spark), blocks * salts)

    def table(block: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pair")
        packed = [rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(np.int64)]
        return pd.DataFrame({"block": [block[0]], "counts": [zstandard.compress(np.concatenate(packed).tobytes(), 1)]})

    best = counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), F.pmod("pair", F.lit(blocks)).cast("int").alias("block"))
    tables = best.groupBy("block").applyInPandas(table, "block int, counts binary")
    tables = tables.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def split(batches):
        for batch in batches:
            found = {"block": [], "row": [], "links": [], "n": []}
            for row, data, n in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = None if blocks == 1 else _unpack(data, n)
                for block in range(blocks):
                    part = pairs if pairs is None else pairs[pairs % blocks == block]
                    if part is None or len(part):
                        found["block"].append(block)
                        found["row"].append(row)
                        found["links"].append(data if part is None else _pack(part))
                        found["n"].append(n if part is None else len(part))
            yield found

    asked = over_batches(linked, split, "block int, row long, links binary, n long").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))

    def look_up(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame({"row": [], "n_best": [], "count_sum": []})
        pairs, n, top = np.frombuffer(zstandard.decompress(known["counts"].iloc[0]), np.int64).reshape(3, -1)
        n_best, count_sum = [], []
        for data, size_ in zip(asks["links"], asks["n"]):
            at = np.searchsorted(pairs, _unpack(data, size_))
            n_best.append(int(top[at].sum()))
            count_sum.append(int(n[at].sum()))
        return pd.DataFrame({"row": asks["row"], "n_best": n_best, "count_sum": count_sum})

    keys = ["block", "salt"]
    dealt = asked.repartition(parts, *keys).groupBy(*keys).cogroup(tables.repartition(parts, *keys).groupBy(*keys))
    sums = dealt.applyInPandas(look_up, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return made.drop("links").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")], "groups_sha256"
    )
