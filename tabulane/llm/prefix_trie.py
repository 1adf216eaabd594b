"""Trie of conversation prefixes: range-partitioned shards below a broadcast skeleton.

A conversation is a path: 24 bytes per turn, a 128-bit hash of role and text and the byte length of the text. Paths sort like
a depth-first walk of the trie, so a sorted range of (path, conversation) holds all of a node but where a splitter cuts
through it. The nodes on the splitters' own paths, and only those, can lie in several shards: they are the skeleton.
Each shard finishes its other nodes in one pass over its rows; the skeleton nodes' partial sums are added up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tabulane.llm.common import over_batches, partitions
from tabulane.session import cut_lineage

TURN = 24  # bytes of a turn in a path
SAMPLED = 64  # sampled paths per shard, from which splitters are taken
SPLITTER_TURNS = 4096  # a splitter is cut after so many turns; conversations that agree for longer share a shard
CHUNK = 1 << 16  # characters of joined ids a shard sends on at once
ROWS = 20_000  # rows of an output batch

_FIELDS = (
    "kind int, shard int, seq long, skeleton int, parent_skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, bytes long, ends string"
)
_NODE, _PART, _CHUNK = range(3)
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """48 hex digits of a turn; equal for equal role and text, null read as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(both, 256), 1, 32), F.lpad(F.lower(F.hex(F.octet_length(text).cast("long"))), 16, "0"))


def conversation_turns(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns array<string>): the keys of each conversation's turns in order.

    Turns go by `turn`, null first; ties by role, then by the SHA-256 of the text; repeated rows stay. Rows without a
    conversation id belong to none. Other columns are not read. Texts are hashed before the shuffle, so a conversation's row holds 48
    characters and its role per turn; that row has to fit a task.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = table.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), role_.alias("role"), F.sha2(text_, 256).alias("tie"), turn_key(role_, text_).alias("key")).alias("item"),
    )
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return packed.select("conv_id", F.col("items.key").alias("turns"))


def as_path(turns: Column) -> Column:
    return F.unhex(F.array_join(turns, ""))


def rebuilt_paths(turns: DataFrame, block: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, path) of the rebuilt conversations: the first h turns of conversation c - c % block, then c's own after its first h.

    h is crc32 of the decimal id modulo `most`; a missing base gives no turns, a short one all of its own.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    own = turns.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), "turns", head.alias("h"))
    base = turns.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    first = F.coalesce(F.slice("base_turns", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(base, "base", "left").select("conv_id", as_path(F.concat(first, rest)).alias("path"))


class Skeleton:
    """The trie of the splitters' paths: node numbers by (parent, turn); 0 is the root. A parent's number is below its children's."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.nodes: dict[tuple[int, bytes], int] = {}
        self.parents = [-1]
        for path, _ in splitters:
            at = 0
            for i in range(0, len(path), TURN):
                key = (at, path[i : i + TURN])
                if key not in self.nodes:
                    self.nodes[key] = len(self.parents)
                    self.parents.append(at)
                at = self.nodes[key]


def choose_splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 evenly spaced (path, conv_id) of a sample of some 64 paths per shard.

    The sample only balances the shards. It is ordered in Spark; splitters alone, at most 96 KB each, reach the driver.
    """
    n = paths.count()
    every = max(1, n // (SAMPLED * shards))
    some = paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select(F.substring("path", 1, TURN * SPLITTER_TURNS).alias("path"), "conv_id")
    step = max(1, n // every // shards)
    placed = some.withColumn("at", F.row_number().over(Window.orderBy("path", "conv_id")))
    rows = placed.filter(F.col("at") % step == 0).select("path", "conv_id").limit(shards - 1 if shards > 1 else 0).collect()
    return sorted({(bytes(r["path"]), r["conv_id"]) for r in rows})


def _shared(a: bytes, b: bytes) -> int:
    """Turns two paths have in common from the start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    __slots__ = ("skeleton", "bytes", "least", "n", "children", "leaves", "saved", "digest", "ends", "size", "seq", "waiting")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.bytes = skeleton, size
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.digest, self.ends, self.size, self.seq, self.waiting = None, [], 0, 0, []

    def take(self, least: int, n: int) -> None:
        self.least = least if self.least is None or least < self.least else self.least
        self.n += n


class _Shard:
    """One sorted pass: the open nodes are those of the last path. A finished node waits for its parent's smallest member."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard = skeleton, shard
        self.path, self.open, self.out = b"", [_Node(0, 0)], []

    def _row(self, kind, node, depth, parent_skeleton=-1, ends=None, seq=0):
        return [kind, self.shard, seq, node.skeleton, parent_skeleton, node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.bytes, ends]

    def _send_ends(self, node: _Node, depth: int) -> None:
        if node.ends:
            self.out.append(self._row(_CHUNK, node, depth, ends="".join(node.ends), seq=node.seq))
            node.ends, node.size, node.seq = [], 0, node.seq + 1

    def add(self, path: bytes, conv: int) -> None:
        shared = _shared(self.path, path)
        while len(self.open) - 1 > shared:
            self._close()
        for at in range(shared * TURN, len(path), TURN):
            above, turn = self.open[-1].skeleton, path[at : at + TURN]
            number = self.skeleton.nodes.get((above, turn), -1) if above >= 0 else -1
            self.open.append(_Node(number, int.from_bytes(turn[16:], "big")))
        self.path = path
        node = self.open[-1]
        node.take(conv, 1)
        if node.skeleton >= 0:
            text = f"{conv},"
            node.ends.append(text)
            node.size += len(text)
            if node.size >= CHUNK:
                self._send_ends(node, len(self.open) - 1)
        elif node.digest is None:
            node.digest = hashlib.sha256(b"%d" % conv)
        else:
            node.digest.update(b",%d" % conv)

    def _close(self) -> None:
        node = self.open.pop()
        depth = len(self.open)
        if node.skeleton >= 0:
            self._send_ends(node, depth)
            if node.n or node.children:
                self.out.append(self._row(_PART, node, depth))
            return
        node.leaves = node.leaves if node.children else 1
        node.saved += (node.n - 1) * node.bytes
        for row in node.waiting:
            row[7] = node.least
        self.out += node.waiting
        parent = self.open[-1]
        row = self._row(_NODE, node, depth, parent.skeleton, node.digest.hexdigest() if node.digest else EMPTY)
        (self.out if parent.skeleton >= 0 else parent.waiting).append(row)
        parent.take(node.least, node.n)
        parent.children += 1
        parent.leaves += node.leaves
        parent.saved += node.saved

    def finish(self) -> None:
        while self.open:
            self._close()


def _walk(skeleton: Skeleton, schema: pa.Schema):
    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        shard = None
        for batch in batches:
            for number, path, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is None or shard.shard != number:
                    if shard is not None:
                        shard.finish()
                        if shard.out:
                            yield pack(shard.out)
                    shard = _Shard(skeleton, number)
                shard.add(path, conv)
                if len(shard.out) >= ROWS:
                    yield pack(shard.out)
                    shard.out = []
        if shard is not None:
            shard.finish()
            if shard.out:
                yield pack(shard.out)

    return run


def _digests(chunks: DataFrame) -> DataFrame:
    """(skeleton, ends_sha256): the joined ids of each skeleton node's chunks, hashed in order as they stream by."""

    def work(batches):
        at, digest, held = None, None, ""
        for batch in batches:
            found = {"skeleton": [], "ends_sha256": []}
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != at:
                    if at is not None:
                        digest.update(held[:-1].encode())
                        found["skeleton"].append(at)
                        found["ends_sha256"].append(digest.hexdigest())
                    at, digest, held = number, hashlib.sha256(), ""
                digest.update(held.encode())
                held = text
            if found["skeleton"]:
                yield found
        if at is not None:
            digest.update(held[:-1].encode())
            yield {"skeleton": [at], "ends_sha256": [digest.hexdigest()]}

    dealt = chunks.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "seq").select("skeleton", "ends")
    return over_batches(dealt, work, "skeleton int, ends_sha256 string")


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of `paths` (conv_id long, path binary of 24 bytes per turn).

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (over the subtree, (n_convs - 1) times the bytes of the node's last text), ends_sha256 (of the
    comma-joined ids, ascending, of the members that end here).

    An empty path ends at the root; a repeated row counts again; a null id or path is passed over; without paths there is no
    node. Equal paths are dealt out by their ids, so a conversation that very many repeat spans several shards. What one task does
    for such a node is hash the joined ids, in ready chunks: SHA-256 has no parallel form.
    """
    spark = paths.sparkSession
    shards = shards or partitions(spark)
    rows = cut_lineage(paths.select("conv_id", "path").filter("conv_id IS NOT NULL AND path IS NOT NULL"))
    skeleton = Skeleton(choose_splitters(rows, shards))
    shared = spark.sparkContext.broadcast(skeleton)  # below `shards` paths of at most SPLITTER_TURNS turns

    def deal(batches):
        splitters = shared.value.splitters
        for batch in batches:
            keys = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            yield {"shard": [bisect_right(splitters, key) for key in keys], "path": batch.column(1), "conv_id": batch.column(0)}

    dealt = over_batches(rows, deal, "shard int, path binary, conv_id long").repartitionById(shards, F.col("shard"))
    fields = StructType.fromDDL(_FIELDS)
    schema = to_arrow_schema(fields)

    def walk(batches):
        yield from _walk(shared.value, schema)(batches)

    found = cut_lineage(dealt.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(walk, fields))
    parts = (
        found.filter(F.col("kind") == _PART)
        .groupBy("skeleton", "depth")
        .agg(F.min("conv_id").alias("least"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("bytes").alias("bytes"))
        .collect()
    )  # one row per skeleton node: as many as were broadcast
    known = {r["skeleton"]: r.asDict() for r in parts}
    for number in range(len(skeleton.parents) - 1, -1, -1):  # children have higher numbers
        node = known.get(number)
        if node is None:
            continue
        node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["bytes"]
        if number:
            above = known.setdefault(
                skeleton.parents[number], {"depth": node["depth"] - 1, "least": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "bytes": 0}
            )
            above["bytes"] = above["bytes"] or _last_bytes(skeleton, skeleton.parents[number])
            above["least"] = node["least"] if above["least"] is None else min(above["least"], node["least"])
            above["n_children"] += 1
            for c in ("n_convs", "n_leaves", "saved_tokens"):
                above[c] += node[c]
    upper = [(i, k["least"], k["depth"], None if i == 0 else known[skeleton.parents[i]]["least"], k["n_convs"], k["n_children"], k["n_leaves"], k["saved_tokens"]) for i, k in known.items()]
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tops = spark.createDataFrame(upper, "skeleton int, " + ", ".join(f"{c} long" for c in kept[:-1]))
    hashes = F.broadcast(_digests(found.filter(F.col("kind") == _CHUNK)))  # at most one row per skeleton node
    tops = tops.join(hashes, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    above = F.broadcast(spark.createDataFrame([(i, k["least"]) for i, k in known.items()], "parent_skeleton int, _least long"))
    nodes = found.filter(F.col("kind") == _NODE).join(above, "parent_skeleton", "left")
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_least")).withColumnRenamed("ends", "ends_sha256")
    return nodes.select(*kept).unionByName(tops.select(*kept))


def _last_bytes(skeleton: Skeleton, number: int) -> int:
    """Bytes of the last text of a skeleton node."""
    if not hasattr(skeleton, "last"):
        skeleton.last = {n: int.from_bytes(turn[16:], "big") for (_, turn), n in skeleton.nodes.items()}
    return skeleton.last.get(number, 0)


def conversation_trie(table: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns; see conversation_turns for nulls and ties."""
    return prefix_trie(rebuilt_paths(conversation_turns(table)), shards)
