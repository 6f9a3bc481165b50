"""The prefix trie of conversations, built by an LCP-aware external mergesort.

A turn is a 16-byte digest, a conversation the digests of its turns one after the
other, so plain byte order puts conversations with a common beginning together.
Conversations are range-partitioned on (turns, conv_id). Each task sorts runs of
bounded size, spools them with the number of turns that neighbours share, and
merges them by a tree of losers that compares only beyond shared turns. Over the
merged stream a stack holds the nodes of the open path, and a node is given out
when the path leaves it.

Nodes on a task's first and last path may go on in other tasks. These alone, two
paths a task, come together in one short stream of the same kind.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

SYMBOL = 16
#: Conversations of a sorted run, and of a block that the merge reads of it.
RUN_ROWS, BLOCK_ROWS = 4096, 256
#: Characters of ids that an open node hands on in a row.
ENDS = 1 << 20

_SPOOL = pa.schema([("conv_id", pa.int64()), ("turns", pa.binary()), ("words", pa.list_(pa.int32())), ("lcp", pa.int32())])
_COLUMNS = [("id", "binary"), ("parent", "binary"), ("conv_id", "long"), ("depth", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("ends_sha256", "string"), ("task", "int"), ("place", "long"), ("part", "int"), ("words", "long"), ("ends", "string")]
_FLAT = ", ".join(f"{name} {kind}" for name, kind in _COLUMNS)
_NAMES = [name for name, _ in _COLUMNS]
_ARROW = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in _COLUMNS])


def rebuilt(conversations: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, turns (digests of role and text, joined), words (of each turn): conversations that share beginnings.

    Conversation c is the first h turns of conversation c - c % block, then its own turns
    after its first h, with h = crc32(decimal c) % heads. Turns come in order, null first,
    equal ones by digest; null roles and texts count as empty; rows without conv_id make up
    no conversation. A task holds a conversation; one shuffle serves grouping and heads.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    own = F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    conv = F.col("conv_id").cast("long")
    rows = conversations.where("conv_id is not null").select((conv - conv % block).alias("base"), conv.alias("conv_id"), own.alias("turn"))
    # conversations of one base, block or fewer of either sign, share a partition
    convs = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, heads - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    convs = convs.withColumn("head", F.coalesce(head, F.slice("turns", 1, 0))).withColumn("h", h)
    turns = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    convs = convs.select("conv_id", turns.alias("t"))
    return convs.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("turns"), F.col("t.words").cast("array<int>").alias("words"))


# ---------------------------------------------------------------- runs and their merge
def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that a and b have in common at the beginning, of which start are known to be."""
    at, end = start * SYMBOL, min(len(a), len(b))
    while at < end and a[at : at + SYMBOL] == b[at : at + SYMBOL]:
        at += SYMBOL
    return at // SYMBOL


def spooled(batches, run_rows: int = RUN_ROWS) -> list[Iterator[tuple]]:
    """Sorted runs of (turns, conv_id, words, lcp) in one unnamed temporary file, read block by block."""
    file = tempfile.TemporaryFile()
    runs, blocks = [], 0
    with pa.ipc.new_file(pa.PythonFile(file, "w"), _SPOOL) as out:
        for batch in batches:
            for at in range(0, batch.num_rows, run_rows):
                conv, turns, words = (batch.column(i).slice(at, run_rows).to_pylist() for i in range(3))
                order = sorted(range(len(conv)), key=lambda i: (turns[i], conv[i]))
                lcp = [0, *(shared(turns[a], turns[b]) for a, b in zip(order, order[1:]))]
                columns = [[x[i] for i in order] for x in (conv, turns, words)]
                table = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip([*columns, lcp], _SPOOL)], schema=_SPOOL)
                own = table.to_batches(BLOCK_ROWS)
                for block in own:
                    out.write_batch(block)
                runs.append(range(blocks, blocks + len(own)))
                blocks += len(own)
    file.seek(0)
    source = pa.ipc.open_file(pa.PythonFile(file, "r"))

    def rows(numbers):
        for number in numbers:
            conv, turns, words, lcp = (c.to_pylist() for c in source.get_batch(number).columns)
            yield from zip(turns, conv, words, lcp)

    return [rows(numbers) for numbers in runs]


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """One sorted stream of (turns, conv_id, words, lcp with the row before) by a tree of losers.

    Every head knows the turns that it shares with the last row given out. The head that
    shares more comes first without a comparison; equal ones are compared from there on,
    and the loser notes what it shares with the winner.
    """
    k = len(runs)
    if not k:
        return
    heads, lcp = [next(r, None) for r in runs], [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        n = shared(x[0], y[0], lcp[a])
        at = n * SYMBOL
        if (x[0][at : at + SYMBOL], x[1]) > (y[0][at : at + SYMBOL], y[1]):
            a, b = b, a
        lcp[b] = n
        return a, b

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    while heads[best] is not None:
        turns, conv, words, _ = heads[best]
        yield turns, conv, words, lcp[best]
        heads[best] = next(runs[best], None)
        lcp[best] = heads[best][3] if heads[best] else 0
        node = (k + best) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


# ---------------------------------------------------------------- nodes from the open path
class _Node:
    """A node of the open path; n, least, children, leaves and saved gather from the nodes below that are finished."""

    __slots__ = ("prefix", "parent", "depth", "words", "place", "edge", "n", "least", "children", "leaves", "saved", "ends")

    def __init__(self, parent: _Node | None, symbol: bytes, words: int, place: int, edge: bool):
        self.prefix = parent.prefix.copy() if parent else hashlib.blake2b(digest_size=SYMBOL)
        self.prefix.update(symbol)
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0
        self.words, self.place, self.edge = words, place, edge
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = 0, None, 0, 0, 0, []

    def row(self, **more) -> dict:
        parent = self.parent.prefix.digest() if self.parent else None
        return {"id": self.prefix.digest(), "parent": parent, "conv_id": self.least, "depth": self.depth, "n_convs": self.n, "n_children": self.children, "n_leaves": self.leaves, "saved_tokens": self.saved, **more}

    def finished(self) -> dict:
        """The whole node's row; the parent takes over its sums."""
        self.leaves, self.saved = self.leaves or 1, self.saved + (self.n - 1) * self.words
        up = self.parent
        if up:
            up.n, up.least = up.n + self.n, self.least if up.least is None else min(up.least, self.least)
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + self.leaves, up.saved + self.saved
        return self.row(ends_sha256=hashlib.sha256(",".join(map(str, self.ends)).encode()).hexdigest())

    def open(self, task: int) -> Iterator[dict]:
        """What this task knows of a node that others may know too; long lists of ids in parts."""
        ids = ",".join(map(str, self.ends))
        yield self.row(task=task, place=self.place, part=0, words=self.words, ends=ids[:ENDS])
        for i, at in enumerate(range(ENDS, len(ids), ENDS), 1):
            yield {"id": self.prefix.digest(), "depth": self.depth, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "task": task, "place": self.place, "part": i, "words": self.words, "ends": ids[at : at + ENDS]}


def nodes(rows: Iterator[tuple], task: int) -> Iterator[dict]:
    """Rows of finished nodes, and of those on the first and last path."""
    path: list[_Node] = []
    place = count()
    for turns, conv, words, lcp in rows:
        first = not path
        if first:
            path.append(_Node(None, b"", 0, next(place), True))
        while len(path) > lcp + 1:
            node = path.pop()
            yield from node.open(task) if node.edge else [node.finished()]
        for i in range(len(path) - 1, len(turns) // SYMBOL):
            path.append(_Node(path[-1], turns[i * SYMBOL : (i + 1) * SYMBOL], words[i], next(place), first))
        top = path[-1]
        top.n, top.least = top.n + 1, conv if top.least is None else min(top.least, conv)
        top.ends.append(conv)
    for node in path:
        yield from node.open(task)


def _batched(rows: Iterator[dict], size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size or row.get("ends") and len(row["ends"]) == ENDS:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


def _sorted_nodes(run_rows: int):
    def run(batches):
        from pyspark import TaskContext

        yield from _batched(nodes(merged(spooled(batches, run_rows)), TaskContext.get().partitionId()))

    return run


class _Edge:
    """A node that several tasks know of: sums so far, and its ids hashed as they come."""

    def __init__(self, row: dict):
        self.row, self.ends, self.some = row | {"conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0}, hashlib.sha256(), False

    def add(self, row: dict) -> None:
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            self.row[name] += row[name]
        self.least(row["conv_id"])
        if row["ends"]:
            self.ends.update(("," if self.some and not row["part"] else "").encode() + row["ends"].encode())
            self.some = True

    def least(self, conv: int | None) -> None:
        known = self.row["conv_id"]
        self.row["conv_id"] = known if conv is None else conv if known is None else min(known, conv)

    def finished(self, up: _Edge | None) -> dict:
        r = self.row
        r["n_leaves"], r["saved_tokens"] = r["n_leaves"] or 1, r["saved_tokens"] + (r["n_convs"] - 1) * r["words"]
        if up:
            up.row["n_children"] += 1
            for name in ("n_convs", "n_leaves", "saved_tokens"):
                up.row[name] += r[name]
            up.least(r["conv_id"])
        return {k: r[k] for k in _NAMES[:8]} | {"ends_sha256": self.ends.hexdigest()}


def joined_paths(rows: Iterator[dict]) -> Iterator[dict]:
    """Nodes of the tasks' first and last paths, in the order of tasks and places, as whole nodes."""
    path: list[_Edge] = []
    for row in rows:
        depth = row["depth"]
        if depth >= len(path) or path[depth].row["id"] != row["id"]:
            while len(path) > depth:
                edge = path.pop()
                yield edge.finished(path[-1] if path else None)
            path.append(_Edge(row))
        path[depth].add(row)
    while path:
        edge = path.pop()
        yield edge.finished(path[-1] if path else None)


def _join_paths(batches):
    yield from _batched(joined_paths(row for batch in batches for row in batch.to_pylist()))


def prefix_trie(conversations: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """A row for each node of the trie of rebuilt() conversations, root included.

    id and parent (digests of the turns up to a node), conv_id (smallest member), depth,
    parent_conv_id (the parent's conv_id; null at the root), n_convs (members),
    n_children, n_leaves (childless nodes in the subtree, itself included), saved_tokens
    (over the subtree, members but one times the words of the last turn) and ends_sha256
    (of the ids of the conversations that end here, ascending, joined by commas).

    No conversations, no rows, not even a root. Columns beyond conv_id, turn, role and
    text are not read.
    """
    convs = rebuilt(conversations).repartitionByRange("turns", "conv_id")
    found = cut(convs.mapInArrow(_sorted_nodes(run_rows), _FLAT))
    edges = found.where("place is not null").repartition(1).sortWithinPartitions("task", "place", "part")  # two paths a task
    whole = cut(found.where("place is null").select(*_NAMES[:9]).unionByName(edges.mapInArrow(_join_paths, _FLAT).select(*_NAMES[:9])))
    drop(found)
    # nodes with a thousandth of all nodes as children are a thousand at most
    total = whole.count()
    up = whole.where("n_children > 0")
    many = F.col("n_children") * 1000 >= total
    broad = up.where(many).select(F.col("id").alias("parent"), F.col("conv_id").alias("broad"))
    out = whole.join(F.broadcast(broad), "parent", "left")
    # a row with its parent found has a key of its own that no id equals
    own = F.when(F.col("parent").isNull() | F.col("broad").isNotNull(), F.concat("id", F.lit(b"\0"))).otherwise(F.col("parent"))
    narrow = up.where(~many).select(F.col("id").alias("key"), F.col("conv_id").alias("narrow"))
    out = out.withColumn("key", own).join(narrow, "key", "left")
    return out.select("id", "parent", "conv_id", "depth", F.coalesce("broad", "narrow").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
