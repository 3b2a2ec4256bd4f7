"""Exact dedup by Patricia-trie owners.

A key is the content hash of a text, its length and its bytes; tries hold keys whole, so a trie's upper levels are the
hash and the length, and texts that only share those part below.  Terminal nodes store the smallest identifier, the owner.

Before anything moves, each task inserts the texts that it reads into a trie and passes on one row for every text of
its own, so that a text of many copies, however many, is sent once a task and burdens no one task.  Beyond SPILL bytes the
largest subtree, by the first byte of the hash, is spilled: what it knows is sent on, and it is dropped.

Then rows are partitioned and sorted by hash and length, so equal texts meet in one task, one after the other, the one with
the smallest identifier first.  All rows of a task go into one trie.  As keys arrive in order, every subtree but the one
under the present hash and length is complete; beyond SPILL bytes the complete ones, whose results are written already, are
dropped, so a task's memory is bounded, and Spark's external sort does the rest.

Defined results: null texts are equal to nothing, not even to each other; each
is its own owner.  The empty text is a text like any other, and so is one of any length.  Of repeated rows
with one doc_id, one counts as the owner's row.  A null doc_id sorts after all
others, so it owns a text only if no row with the text has a doc_id.  An empty table gives an empty one.  Other
columns, whatever their names, are passed on unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import tidy
from tesserae.llm.text import fresh

SPILL = 64 << 20


class Node:
    """owner: of a terminal node, a list that begins with the smallest identifier."""

    __slots__ = ("edges", "label", "owner")

    def __init__(self, label: bytes):
        self.label, self.owner, self.edges = label, None, None


def before(a, b) -> bool:
    """Whether identifier a is smaller than b; None is larger than all others."""
    return a is not None and (b is None or a < b)


class PatriciaTrie:
    """Compressed radix trie over byte strings; bytes: about how many each subtree of the root holds."""

    def __init__(self):
        self.root, self.bytes = Node(b""), {}

    def insert(self, key: bytes, ident) -> Node:
        """The terminal node of key, which keeps the smallest identifier."""
        node, at = self.root, 0
        while at < len(key):
            if node.edges is None:
                node.edges = {}
            child = node.edges.get(key[at])
            if child is None:
                child = node.edges[key[at]] = Node(key[at:])
                self.bytes[key[0]] = self.bytes.get(key[0], 0) + len(key) - at + 200
                node, at = child, len(key)
                continue
            label, rest = child.label, len(key) - at
            if rest >= len(label) and key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same, stop = 0, min(len(label), rest)
            step = stop
            while step:  # longest common prefix by halving
                if label[same : same + step] == key[at + same : at + same + step]:
                    same += step
                    step = min(step, stop - same)
                else:
                    step //= 2
            upper = Node(label[:same])
            upper.edges = {label[same]: child}
            child.label = label[same:]
            node.edges[key[at]] = upper
            node, at = upper, at + same
        if node.owner is None:
            node.owner = [ident]
        elif before(ident, node.owner[0]):
            node.owner[0] = ident
        return node

    def size(self) -> int:
        return sum(self.bytes.values())

    def spill(self, first: int | None = None) -> Iterator[tuple[bytes, Node]]:
        """Cuts off the subtree under this first byte, or the largest one, and gives its keys and terminal nodes."""
        if not self.bytes:
            return
        first = max(self.bytes, key=self.bytes.get) if first is None else first
        del self.bytes[first]
        todo = [(b"", self.root.edges.pop(first))]
        while todo:
            head, node = todo.pop()
            key = head + node.label
            if node.owner is not None:
                yield key, node
            todo += [(key, x) for x in (node.edges or {}).values()]


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with two added columns, hash and length (null: null text), and their names."""
    data = F.col("text").cast("string")
    key = [fresh(docs.columns, "__hash"), fresh(docs.columns, "__len")]
    return docs.withColumns({key[0]: F.xxhash64(data, F.when(data.isNull(), F.xxhash64("doc_id"))), key[1]: F.length(F.encode(data, "utf-8"))}), key


def _met(rows: DataFrame, key: list[str], ident: str) -> DataFrame:
    return rows.repartition(*key).sortWithinPartitions(*key, F.col(ident).asc_nulls_last())


def _keys(batch: pa.RecordBatch, text: int, h: int, n: int) -> Iterator[bytes | None]:
    """The rows' keys: hash, length, bytes; None for null texts."""
    data = batch.column(text).cast(pa.binary())
    head = np.empty(batch.num_rows, [("h", ">u8"), ("n", ">u4")])
    head["h"], head["n"] = batch.column(h).to_numpy().view(np.uint64), batch.column(n).fill_null(0).to_numpy()
    for i, x in enumerate(data):
        yield head[i].tobytes() + x.as_py() if x.is_valid else None


def _nodes(batches: Iterator[pa.RecordBatch], ident: int, text: int, h: int, n: int, spill: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Every batch with the rows' terminal nodes (None: null text), by one trie; rows come by hash and length."""
    trie, here = PatriciaTrie(), None
    for b in batches:
        nodes = []
        for key, i in zip(_keys(b, text, h, n), b.column(ident).to_pylist()):
            if key is None:
                nodes.append(None)
                continue
            if key[:12] != here:
                here = key[:12]
                if trie.size() > spill:
                    trie = PatriciaTrie()  # all its subtrees are complete
            nodes.append(trie.insert(key, i))
        yield b, nodes


def owners(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """(doc_id, owner_id) for every row: the smallest doc_id with the same bytes of text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["h", "n", "text", "least", "ids"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each text of this task, with the identifiers of its rows; for null texts one each."""
        trie, types = PatriciaTrie(), None

        def sent(found):
            found = list(found)
            for k in range(0, len(found), 2000):
                part = found[k : k + 2000]
                head = np.frombuffer(b"".join(key[:12] for key, _ in part), [("h", ">u8"), ("n", ">u4")])
                cols = [head["h"].astype(np.uint64).view(np.int64), head["n"].astype(np.int32), [key[12:] for key, _ in part], [x.owner[0] for _, x in part], [x.owner[1:] for _, x in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in batches:
            types = types or [pa.int64(), pa.int32(), pa.binary(), b.column(0).type, pa.list_(b.column(0).type)]
            null = b.column(1).is_null()
            if b.column(1).null_count:
                x = b.filter(null)
                ids = x.column(0)
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32)), ids)
                yield pa.RecordBatch.from_arrays([x.column(2), x.column(3), x.column(1).cast(pa.binary()), ids, each.cast(types[4])], names=names)
            for key, i in zip(_keys(b, 1, 2, 3), b.column(0).to_pylist()):
                if key is not None:
                    trie.insert(key, i).owner.append(i)
                    trie.bytes[key[0]] += 40
            while trie.size() > spill:
                yield from sent(trie.spill())
        while trie.bytes:
            yield from sent(trie.spill())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, nodes in _nodes(batches, 3, 2, 0, 1, spill):
            ids = b.column(4)
            least = b.column(3).to_pylist()
            owner = pa.array([i if x is None else x.owner[0] for x, i in zip(nodes, least)], b.column(3).type)
            row = np.repeat(np.arange(b.num_rows), ids.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([ids.flatten(), owner.take(pa.array(row))], names=["doc_id", "owner_id"])

    rows, key = _keyed(docs.select("doc_id", "text"))
    sent = rows.select("doc_id", F.col("text").cast("string").alias("text"), *key).mapInArrow(tidy(gather), f"h long, n int, text binary, least {kind}, ids array<{kind}>")
    return _met(sent, ["h", "n"], "least").mapInArrow(tidy(own), f"doc_id {kind}, owner_id {kind}")


def drop_copies(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """One row for every distinct text, the owner's; rows with null text all stay."""
    names = docs.columns
    rows, key = _keyed(docs.toDF(*(fresh(names, f"c{k}") if {".", "`"} & {*c} else c for k, c in enumerate(names))))  # mapInArrow doesn't find such names
    at = [names.index("doc_id"), names.index("text"), len(names), len(names) + 1]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves out rows of a text of which this task has passed on one with a smaller identifier."""
        trie = PatriciaTrie()
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for r, (k, i) in enumerate(zip(_keys(b, *at[1:]), b.column(at[0]).to_pylist())):
                if k is not None:
                    node = trie.insert(k, i)
                    keep[r] = len(node.owner) == 1 or before(i, node.owner[1])
                    if keep[r]:
                        node.owner[1:] = [i]  # the last that was passed on
            while trie.size() > spill:
                for _ in trie.spill():
                    pass  # what it knew is passed on already
            yield b.filter(pa.array(keep))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, nodes in _nodes(batches, *at, spill):
            keep = np.ones(len(nodes), bool)
            for i, x in enumerate(nodes):
                if x is not None:
                    keep[i] = len(x.owner) == 1  # the first row of this text
                    x.owner[1:] = [True]
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names).filter(pa.array(keep))

    return _met(rows.mapInArrow(tidy(thin), rows.schema), key, "doc_id").mapInArrow(tidy(first), docs.schema)
