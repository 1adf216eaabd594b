"""Removal of bytes that lie in a 100-byte string which also starts earlier, by suffix sorting of candidate windows.

Every 100-byte window has an anchor: the 50-byte string in it with the smallest hash. Equal windows have equal anchors, so only
windows whose anchors are equal can be equal. Neighbouring windows with one anchor form a segment (the anchor
changes every 26 bytes or so); segments, not windows, travel. Of equal segments all but the earliest are repeated
whole. Only where one anchor stands in different segments are their windows sorted: deep-shallow, that is by a
multikey sort to a shallow depth, and the groups that still tie by a blind trie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulane.llm.common import RangeHash, as_bytes, mix64, over_batches, partitions
from tabulane.session import cut_lineage

LENGTH = 100  # bytes of a string that counts as repeated
ANCHOR = 50  # bytes of an anchor
SHALLOW = 24  # bytes the multikey sort looks at
CHUNK = 1 << 24  # windows of a text that are looked at together
MANY = 256  # different segments of one anchor from which their windows are dealt out by content; the result is the same

_RUN = np.dtype([("key", "i8"), ("tag", "i8"), ("n", "u4")])
_SEGMENT = np.dtype([("anchor", "u8"), ("bytes", "u8"), ("start", "u4"), ("more", "u1")])
_REQUEST = np.dtype([("anchor", "u8"), ("start", "u4"), ("more", "u1"), ("many", "u1")])
_WINDOW = np.dtype([("bytes", "u8"), ("start", "u4")])
_SPAN = np.dtype([("start", "u4"), ("end", "u4")])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values: suffix minima of one block against prefix minima of the next."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """The segments of a text: anchor hash, hash of all bytes, first window, number of further windows."""
    found = [np.zeros(0, dtype=_SEGMENT)]
    for at in range(0, len(text) - length + 1, CHUNK):
        data = np.frombuffer(text[at : at + CHUNK + length - 1], dtype=np.uint8)
        hashed = RangeHash(data)
        places = np.arange(len(data) - anchor + 1)
        grams = hashed(places, places + anchor)
        width = length - anchor + 1
        # high bits of the hash, then the place: the leftmost of equal anchors is taken
        low = np.uint64((1 << 26) - 1)
        chosen = (_sliding_least((grams & ~low) | places.astype(np.uint64), width) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.append(first[1:], len(chosen)) - 1
        out = np.empty(len(first), dtype=_SEGMENT)
        out["anchor"], out["bytes"] = grams[chosen[first]], hashed(first, last + length)
        out["start"], out["more"] = first + at, last - first
        found.append(out)
    return np.concatenate(found)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before."""
    out = np.ones(len(keys[0]), dtype=bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def sort_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order the windows data[at : at + length] within their groups: (order, True where one differs from the one before).

    Multikey sort by symbols of eight bytes down to SHALLOW, each level over the rows that still tie; then blind tries.
    """
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    order = np.argsort(group, kind="stable")
    new = _changes(group[order])
    for depth in range(0, SHALLOW, 8):
        tied = _tied(new)
        if not len(tied):
            return order, new
        rows = order[tied]
        run = np.cumsum(new[tied])
        symbol = words[at[rows] + depth].view(">u8").ravel().astype(np.uint64)
        inner = np.lexsort((symbol, run))
        order[tied] = rows[inner]
        new[tied] = _changes(run[inner], symbol[inner])
    tied = _tied(new)
    if len(tied):
        rows = order[tied]
        rest = np.lib.stride_tricks.sliding_window_view(data, length - SHALLOW)[at[rows] + SHALLOW]
        inner, differs = blind_trie(rest, np.cumsum(new[tied]))
        order[tied], new[tied] = rows[inner], differs
    return order, new


def _tied(new: np.ndarray) -> np.ndarray:
    """Rows in runs of more than one."""
    single = new & np.append(new[1:], True)
    return np.flatnonzero(~single)


def blind_trie(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order equally long strings (rows) within their groups, which come in runs: (order, True where one differs from the one before).

    Each group's trie grows from its root by levels, all groups at once: only the place where its strings first
    branch is looked up (the bytes they share are skipped), and they part by the byte there.
    """
    order, new = np.arange(len(strings)), _changes(group)
    active = np.arange(len(strings))  # positions in `order` that still are to be parted
    while len(active):
        start = np.flatnonzero(new[active])
        sizes = np.diff(np.append(start, len(active)))
        rows = order[active]
        differs = strings[rows] != np.repeat(strings[rows[start]], sizes, axis=0)
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), strings.shape[1])
        branch = np.repeat(np.minimum.reduceat(shared, start), sizes)
        parted = branch < strings.shape[1]
        active, rows, branch = active[parted], rows[parted], branch[parted]
        if not len(active):
            break
        run = np.cumsum(new[active])
        byte = strings[rows, branch]
        inner = np.lexsort((byte, run))
        order[active], new[active] = rows[inner], _changes(run[inner], byte[inner])
        active = active[_tied(new[active])]
    return order, new


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by some spans."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(reach) - 1)]


def _pack(part: np.ndarray, key: np.ndarray, tag: np.ndarray, items: np.ndarray, parts: int):
    """(part, runs, items, rows) of rows that stand in runs of one document."""
    small = part.astype(np.uint16 if parts < 1 << 16 else np.uint32)
    order = np.argsort(small, kind="stable")
    bounds = np.searchsorted(small[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        rows = order[bounds[k] : bounds[k + 1]]
        cuts = np.append(np.flatnonzero(_changes(key[rows], tag[rows])), len(rows))
        runs = np.empty(len(cuts) - 1, dtype=_RUN)
        runs["key"], runs["tag"], runs["n"] = key[rows[cuts[:-1]]], tag[rows[cuts[:-1]]], np.diff(cuts)
        yield int(k), runs.tobytes(), items[rows].tobytes(), rows


class _Rows:
    """Rows out of blobs: items, their documents, and `when`, which orders them by document and start."""

    def __init__(self, blobs: pd.DataFrame, item: np.dtype):
        runs = np.frombuffer(b"".join(blobs["runs"]), dtype=_RUN)
        self.items = np.frombuffer(b"".join(blobs["items"]), dtype=item)
        by_doc = np.lexsort((runs["tag"], runs["key"]))
        place = np.empty(len(runs), dtype=np.uint64)
        place[by_doc] = np.cumsum(_changes(runs["key"][by_doc], runs["tag"][by_doc])).astype(np.uint64)
        self.key, self.tag = np.repeat(runs["key"], runs["n"]), np.repeat(runs["tag"], runs["n"])
        self.place = np.repeat(place, runs["n"])
        self.when = self.place << np.uint64(32) | self.items["start"].astype(np.uint64)

    def spans(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int):
        """Blobs of removed spans, sent to their documents."""
        order = np.lexsort((start, self.place[rows]))
        rows, start, end = rows[order], start[order], end[order]
        # spans of one document that touch become one
        base = self.place[rows].astype(np.int64) << 33
        s, e = merged(base + start, base + end)
        which = rows[np.searchsorted(base + start, s)]
        items = np.empty(len(s), dtype=_SPAN)
        items["start"], items["end"] = s & ((1 << 33) - 1), e & ((1 << 33) - 1)
        return _pack(_home(self.key[which], self.tag[which], parts), self.key[which], self.tag[which], items, parts)


def _home(key: np.ndarray, tag: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(key.view(np.uint64) ^ mix64(tag.view(np.uint64))) >> np.uint64(24)) % np.uint64(parts)


_BLOBS = "part int, kind int, runs binary, items binary"
_SPANS, _OPEN = 0, 1


def _columns(kind: int, packed) -> dict:
    part, runs, items, _ = packed
    return {"part": [part], "kind": [kind], "runs": [runs], "items": [items]}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{k: v[0] for k, v in r.items()} for r in rows], columns=["part", "kind", "runs", "items"])


def _find_segments(parts: int):
    """Segments of each text, dealt by anchor; of equal segments of a batch only the earliest, the spans of the others at once."""

    def work(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            cut = [segments(t) for t in texts]
            sizes = [len(s) for s in cut]
            if not sum(sizes):
                continue
            items = np.concatenate(cut)
            keys, tags = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("key", "tag"))
            by_doc = np.lexsort((items["start"], tags, keys))
            order = by_doc[np.argsort(items["bytes"][by_doc], kind="stable")]
            first = _changes(items["bytes"][order])
            twice = ~_changes(items["bytes"][order], keys[order], tags[order], items["start"][order])  # of rows equal in id and text
            lead = np.sort(order[first])
            for packed in _pack((items["anchor"][lead] >> np.uint64(24)) % np.uint64(parts), keys[lead], tags[lead], items[lead], parts):
                yield _columns(_OPEN, packed)
            rest = np.sort(order[~first & ~twice])
            if len(rest):
                spans = np.empty(len(rest), dtype=_SPAN)
                spans["start"] = items["start"][rest]
                spans["end"] = spans["start"] + items["more"][rest] + LENGTH
                for packed in _pack(_home(keys[rest], tags[rest], parts), keys[rest], tags[rest], spans, parts):
                    yield _columns(_SPANS, packed)

    return work


def _compare_segments(parts: int):
    """Spans of the segments that have an equal earlier one; requests for the first of each where an anchor has different ones."""

    def work(blobs: pd.DataFrame) -> pd.DataFrame:
        done = blobs[blobs["kind"] == _SPANS]
        out = [{"part": [p], "kind": [_SPANS], "runs": [r], "items": [i]} for p, r, i in zip(done["part"], done["runs"], done["items"])]
        rows = _Rows(blobs[blobs["kind"] == _OPEN], _SEGMENT)
        items = rows.items
        if len(items):
            order = np.lexsort((rows.when, items["bytes"], items["anchor"]))
            anchor = items["anchor"][order]
            first = _changes(anchor, items["bytes"][order])
            again = order[~first & _changes(rows.when[order])]
            start = items["start"][again].astype(np.int64)
            out += [_columns(_SPANS, p) for p in rows.spans(again, start, start + items["more"][again] + LENGTH, parts)]
            lead, of = order[first], anchor[first]
            cuts = np.append(np.flatnonzero(_changes(of)), len(of))
            kinds = np.repeat(np.diff(cuts), np.diff(cuts))
            pick = np.flatnonzero(kinds > 1)
            pick = pick[np.argsort(rows.when[lead[pick]], kind="stable")]
            asked = lead[pick]
            requests = np.empty(len(asked), dtype=_REQUEST)
            for name in ("anchor", "start", "more"):
                requests[name] = items[name][asked]
            requests["many"] = kinds[pick] > MANY
            out += [_columns(_OPEN, p) for p in _pack(_home(rows.key[asked], rows.tag[asked], parts), rows.key[asked], rows.tag[asked], requests, parts)]
        return _frame(out)

    return work


def _per_document(kind: int, item: np.dtype):
    """One row (key, tag, items) per document from blobs sent to its part."""

    def work(blobs: pd.DataFrame) -> pd.DataFrame:
        rows = _Rows(blobs, item)
        order = np.lexsort((rows.when,))
        cuts = np.append(np.flatnonzero(_changes(rows.place[order])), len(order))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a]
            out.append((int(rows.key[at]), int(rows.tag[at]), rows.items[order[a:b]].tobytes()))
        return pd.DataFrame(out, columns=["key", "tag", "found"])

    return work


def _fetch(parts: int):
    """The bytes of the requested segments, dealt by anchor; single windows dealt by content where an anchor has very many."""

    def work(batches):
        for batch in batches:
            wanted = {False: [], True: []}
            for key, tag, text, found in zip(*(batch.column(c).to_pylist() for c in ("key", "tag")), as_bytes(batch.column("text")), batch.column("found").to_pylist()):
                asked = np.frombuffer(found, dtype=_REQUEST)
                few = asked[asked["many"] == 0]
                if len(few):
                    wanted[False].append((key, tag, few, [text[s : s + m + LENGTH] for s, m in zip(few["start"].tolist(), few["more"].tolist())]))
                many = asked[asked["many"] == 1]
                if len(many):
                    n = many["more"].astype(np.int64) + 1
                    starts = np.repeat(many["start"].astype(np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum())
                    windows = np.empty(len(starts), dtype=_WINDOW)
                    windows["start"], windows["bytes"] = starts, RangeHash(np.frombuffer(text, dtype=np.uint8))(starts, starts + LENGTH)
                    wanted[True].append((key, tag, windows, None))
            for many, docs in wanted.items():
                if not docs:
                    continue
                items = np.concatenate([d[2] for d in docs])
                sizes = [len(d[2]) for d in docs]
                keys, tags = (np.repeat(np.array([d[i] for d in docs], dtype=np.int64), sizes) for i in (0, 1))
                deal = items["bytes" if many else "anchor"]
                pieces = None if many else [p for d in docs for p in d[3]]
                for part, runs, packed, rows in _pack((deal >> np.uint64(24)) % np.uint64(parts), keys, tags, items, parts):
                    data = b"" if many else b"".join(map(pieces.__getitem__, rows.tolist()))
                    yield {"part": [part], "many": [many], "runs": [runs], "items": [packed], "data": [data]}

    return work


def _compare_windows(parts: int):
    """Spans of the windows that have an equal earlier one."""

    def work(blobs: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = _Rows(blobs[blobs["many"]], _WINDOW)
        if len(rows.items):
            order = np.lexsort((rows.when, rows.items["bytes"]))
            again = order[~_changes(rows.items["bytes"][order]) & _changes(rows.when[order])]
            start = rows.items["start"][again].astype(np.int64)
            out += [_columns(_SPANS, p) for p in rows.spans(again, start, start + LENGTH, parts)]
        few = blobs[~blobs["many"]]
        rows = _Rows(few, _REQUEST)
        if len(rows.items):
            data = np.frombuffer(b"".join(few["data"]), dtype=np.uint8)
            n = rows.items["more"].astype(np.int64) + 1
            before = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)  # where each segment starts in the data
            row = np.repeat(np.arange(len(n)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            when = rows.when[row] + inner.astype(np.uint64)
            earliest = np.argsort(when, kind="stable")  # a stable sort then leaves the earliest of equal windows first
            row, inner = row[earliest], inner[earliest]
            order, new = sort_windows(data, before[row] + inner, rows.items["anchor"][row])
            again = order[~new & _changes(when[earliest][order])]
            start = rows.items["start"][row[again]].astype(np.int64) + inner[again]
            out += [_columns(_SPANS, p) for p in rows.spans(row[again], start, start + LENGTH, parts)]
        return _frame(out)

    return work


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the columns _key, _tag and _spans: packed byte spans (start, end) of each text that are repeated from earlier, or null.

    Earlier is: smaller id, or the same row and an earlier start. A null id comes after all others. Rows of one id go by
    the hash of their text; rows equal in id and text count as one document and get the same spans. Whole texts are shuffled once.
    """
    parts = partitions(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_key")
    keyed = docs.select("*", key, F.xxhash64(F.col(text_col)).alias("_tag"))
    texts = keyed.select(F.col("_key").alias("key"), F.col("_tag").alias("tag"), F.col(text_col).alias("text"))
    found = over_batches(texts, _find_segments(parts), _BLOBS).groupBy("part").applyInPandas(_compare_segments(parts), _BLOBS)
    found = cut_lineage(found)
    per_doc = "key long, tag long, found binary"
    asked = found.filter(F.col("kind") == _OPEN).groupBy("part").applyInPandas(_per_document(_OPEN, _REQUEST), per_doc)
    # the same columns on both sides of the plan, so that one shuffle of the texts serves both joins
    with_asked = keyed.join(asked, (F.col("_key") == F.col("key")) & (F.col("_tag") == F.col("tag")))
    if text_col != "text":
        with_asked = with_asked.withColumn("text", F.col(text_col))
    fetched = over_batches(with_asked, _fetch(parts), "part int, many boolean, runs binary, items binary, data binary")
    more = fetched.groupBy("part").applyInPandas(_compare_windows(parts), _BLOBS)
    spans = found.filter(F.col("kind") == _SPANS).unionByName(more).groupBy("part").applyInPandas(_per_document(_SPANS, _SPAN), per_doc)
    spans = spans.withColumnRenamed("found", "_spans")
    return keyed.join(spans, (F.col("_key") == F.col("key")) & (F.col("_tag") == F.col("tag")), "left").drop("key", "tag")


def cut_spans(text: bytes, spans: bytes | None, whole_characters: bool = False) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, runs removed); with `whole_characters` a run shrinks to the characters wholly inside."""
    found = np.frombuffer(spans or b"", dtype=_SPAN).astype([("start", "i8"), ("end", "i8")])
    starts, ends = merged(found["start"], found["end"])
    kept, at, removed, runs = [], 0, 0, 0
    for start, end in zip(starts.tolist(), ends.tolist()):
        if whole_characters:
            while start < end and text[start] & 0xC0 == 0x80:
                start += 1
            while start < end < len(text) and text[end] & 0xC0 == 0x80:
                end -= 1
        if start < end:
            kept.append(text[at:start])
            at, removed, runs = end, removed + end - start, runs + 1
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every whole text as UTF-8; null texts are empty.

    Texts of fewer than 100 bytes have no repeat. Ties, null ids and repeated rows as in find_repeats; an empty table gives none;
    other columns are not read.
    """

    def work(batches):
        for batch in batches:
            n, removed, runs, digests = [], [], [], []
            for text, spans in zip(as_bytes(batch.column("text")), batch.column("_spans").to_pylist()):
                kept, cut, k = cut_spans(text, spans)
                n.append(len(text))
                removed.append(cut)
                runs.append(k)
                digests.append(hashlib.sha256(kept).hexdigest())
            yield {"id": batch.column("id"), "n_bytes": n, "n_removed": removed, "n_spans": runs, "kept_sha256": digests}

    kind = docs.schema[id_col].dataType.simpleString()
    found = find_repeats(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    out = over_batches(found, work, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated spans cut out of the text; characters that lie in a span only in part stay. A null text stays null."""

    @F.pandas_udf("string")
    def strip(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else cut_spans(t.encode(), s, True)[0].decode() for t, s in zip(text, spans)], dtype=object)

    found = find_repeats(docs, id_col, text_col)
    kept: Column = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(strip(F.col(text_col), F.col("_spans")))
    return found.withColumn(text_col, kept).select(*docs.columns)
