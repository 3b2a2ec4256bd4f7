"""Substring dedup: windows of W words that occur more than once, found behind a count-min prefilter.

A window has W - K + 1 cores, the runs of K words in it; its anchors are the
cores with the smallest hash (winnowing).  Equal windows have equal anchors, so
a window can only be repeated if its anchor is, and about 2 / (W - K + 2) of
all positions are anchors.

Pass 1 sends the anchors' hashes to shards.  A shard adds those of every map
batch to its count-min sketch (adding a batch is merging its sketch) and
keeps the anchors whose estimate is at least 2.  Estimates never fall below
the counts, so no repeated window is lost; the few that collide are dropped by
pass 2, which hashes only the windows of kept anchors and groups those exactly,
by 96 bits of hash.  Sketches live in their shard alone; nothing is
broadcast, and a shard's memory doesn't grow with the corpus.

The first occurrence of a window, by (doc_id, position), stays; words that any
later occurrence covers are duplicates.  Words are runs between ASCII white
space, compared exactly.

Defined results: texts that are null, or shorter than W words, have no windows.
Identical rows (same doc_id and text) are one row.  Rows with null doc_id are
never cut and count for nothing.  Rows of one doc_id with different texts are
different documents that come in order of their text's hash.  Columns other than
doc_id and text, whatever their names, are passed on unread.  Texts of any length are searched whole.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.pack import by_shard, lists, narrow, packed, unpacked, widened
from tesserae.llm.shared import tidy, tidy_group
from tesserae.llm.text import chunks, flat, fresh, gram_hashes, mix, pieces, quoted, rows_of, shards, word_hashes, words

W, K = 50, 25
U = np.uint64
MAX = U(2**64 - 1)
SPANS = "doc_id long, start_word int, end_word int"


class CountMin:
    """Count-min sketch with numpy counters that stop at 255; sketches of one shape merge by addition."""

    def __init__(self, width: int, depth: int = 2):
        self.width, self.cells = 1 << max(10, int(width - 1).bit_length()), np.zeros((depth, 1 << max(10, int(width - 1).bit_length())), np.uint8)

    def at(self, keys: np.ndarray, row: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + U(0x632BE59BD9B4E019) * U(row + 1)) & U(self.width - 1)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for r, cells in enumerate(self.cells):
            at, n = np.unique(self.at(keys, r), return_counts=True)
            cells[at] = np.minimum(cells[at].astype(np.int64) + n, 255)

    def merge(self, other: CountMin) -> None:
        self.cells = np.minimum(self.cells.astype(np.uint16) + other.cells, 255).astype(np.uint8)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([cells[self.at(keys, r)] for r, cells in enumerate(self.cells)])


def _slide(x: np.ndarray, n: int, f, fill) -> np.ndarray:
    """f over x[i : i + n] for every i; `fill` beyond the end."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        moved = np.full_like(out, fill)
        moved[: max(0, len(out) - step)] = out[step:]
        out, have = f(out, moved), have + step
    return out


def _cores(h: np.ndarray, wo: np.ndarray, w: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core hashes by position, the smallest in each window by its start, and whether a window starts there."""
    g = np.full(len(h), MAX)
    g[: max(0, len(h) - k + 1)] = gram_hashes(h, k)
    starts = np.arange(len(h)) + w <= wo[1:][rows_of(wo)]
    return g, _slide(g, w - k + 1, np.minimum, MAX), starts


def anchors(h: np.ndarray, wo: np.ndarray, w: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the cores that are smallest in some window."""
    g, least, starts = _cores(h, wo, w, k)
    top = _slide(np.where(starts, least, U(0))[::-1], w - k + 1, np.maximum, U(0))[::-1]
    at = np.flatnonzero((top == g) & (top > U(0)))
    return at, g[at]


def _flagged(table: pa.Table) -> pa.Table:
    """Anchors that a shard's merged sketch estimates to be repeated, by document."""
    key = widened(table)
    sketch = CountMin(8 * max(1, len(key)))
    done = 0
    for row in table["p1"]:
        n = len(row.as_buffer())
        sketch.add(key[done : done + n])
        done += n
    keep = sketch.estimate(key) >= 2
    doc, text, pos = (unpacked(table[c], t)[keep] for c, t in (("p2", np.int64), ("p3", np.int64), ("p4", np.int32)))
    return _by_doc(doc, text, pos)


def _by_doc(doc: np.ndarray, text: np.ndarray, pos: np.ndarray) -> pa.Table:
    order = np.lexsort((pos, text, doc))
    doc, text, pos = doc[order], text[order], pos[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return pa.table({"doc_id": pa.array(doc[cut], pa.int64()), "th": pa.array(text[cut], pa.int64()), "at": lists(pos, np.r_[cut, len(pos)], pa.int32())})


def _repeated(table: pa.Table) -> pa.Table:
    """All but the first of every group of equal windows."""
    key, more, doc, text, pos = (unpacked(table[f"p{i}"], t) for i, t in enumerate((np.uint64, np.uint32, np.int64, np.int64, np.int32)))
    order = np.lexsort((pos, text, doc, more, key))
    key, more, doc, text, pos = key[order], more[order], doc[order], text[order], pos[order]
    same = (key[1:] == key[:-1]) & (more[1:] == more[:-1])
    again = same & (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (pos[1:] == pos[:-1])  # a row that is there twice
    once = np.r_[True, ~again]
    key, more, doc, text, pos = key[once], more[once], doc[once], text[once], pos[once]
    later = np.r_[False, (key[1:] == key[:-1]) & (more[1:] == more[:-1])]
    return _by_doc(doc[later], text[later], pos[later])


AT = "doc_id long, th long, at array<int>"


def _together(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("at")).alias("at"))


def _repeated_starts(docs: DataFrame, w: int, k: int) -> DataFrame:
    """(doc_id, th, at): starts of the windows of a document that occur earlier."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    docs = docs.withColumn("th", F.xxhash64("text"))
    parts = shards(docs)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(batch):
            ids, ths = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            found = []
            for a, b in chunks(batch.column(1)):
                buf, o = flat(batch.column(1).slice(a, b - a))
                s, e, wo = words(buf, o)
                at, key = anchors(word_hashes(buf, s, e), wo, w, k)
                row = np.searchsorted(wo, at, "right") - 1
                found.append((key, ids[a:b][row], ths[a:b][row], (at - wo[row]).astype(np.int32)))
            if found:
                key, *rest = (np.concatenate(x) for x in zip(*found))
                yield packed(key, [*narrow(key), *rest], parts)

        yield from pieces(batches, make)

    packs = "shard int, p0 binary, p1 binary, p2 binary, p3 binary, p4 binary"
    kept = _together(by_shard(docs.mapInArrow(tidy(anchored), packs), parts).groupBy("shard").applyInArrow(tidy_group(_flagged), AT))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(batch):
            ids, ths, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            found = []
            for a, b in chunks(batch.column(1)):
                buf, o = flat(batch.column(1).slice(a, b - a))
                s, e, wo = words(buf, o)
                h = word_hashes(buf, s, e)
                g, least, starts = _cores(h, wo, w, k)
                part = marks.slice(a, b - a)
                mark = part.flatten().to_numpy() + np.repeat(wo[:-1], np.diff(part.offsets.to_numpy()))
                some = np.full(len(h), MAX)
                some[mark] = g[mark]
                at = np.flatnonzero(starts & (_slide(some, w - k + 1, np.minimum, MAX) == least))
                at = at[at + w <= len(h)]
                row = np.searchsorted(wo, at, "right") - 1
                found.append((gram_hashes(h, w)[at], (gram_hashes(mix(h + U(1)), w)[at] >> U(32)).astype(np.uint32), ids[a:b][row], ths[a:b][row], (at - wo[row]).astype(np.int32)))
            if found:
                cols = [np.concatenate(x) for x in zip(*found)]
                yield packed(cols[0], cols, parts)

        yield from pieces(batches, make)

    candidates = docs.join(kept, ["doc_id", "th"]).select("doc_id", "text", "th", "at")
    return _together(by_shard(candidates.mapInArrow(tidy(windows), packs), parts).groupBy("shard").applyInArrow(tidy_group(_repeated), AT))


def _merged(at: np.ndarray, row: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the unions of windows."""
    order = np.lexsort((at, row))
    at, row = at[order].astype(np.int64), row[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + w)]
    start = np.flatnonzero(new)
    return row[start], at[start], at[np.r_[start[1:] - 1, len(at) - 1]] + w


def repeated_spans(docs: DataFrame, w: int = W, k: int = K) -> DataFrame:
    """(doc_id, start_word, end_word): maximal spans of words that repeated windows cover, first occurrences apart.

    The end is exclusive.  For the defined results see the module's docstring.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = b.column(2)
                row, s, e = _merged(at.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy())), w)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc_id", "start_word", "end_word"])

    return _repeated_starts(docs, w, k).select("doc_id", "th", "at").mapInArrow(spans, SPANS)


def cut_repeats(docs: DataFrame, w: int = W, k: int = K) -> DataFrame:
    """The documents without their repeated spans; those of which nothing is left go.  n_chars, if there is such a column, counts what is left."""
    names = docs.columns
    ident, th, spans, cleaned = (fresh(names, c) for c in ("__id", "__th", "__at", "__text"))
    marks = _repeated_starts(docs, w, k).select(F.col("doc_id").alias(ident), F.col("th").alias(th), F.col("at").alias(spans))
    joined = docs.join(marks, (F.col("doc_id") == F.col(ident)) & (F.xxhash64(F.col("text").cast("string")) == F.col(th)), "left")

    @F.pandas_udf("string")
    def cut(text, at):
        import pandas as pd

        out = []
        for x, marks in zip(text, at):
            if x is None:
                out.append(None)
                continue
            buf, o = flat(pa.array([x]))
            s, _, _ = words(buf, o)
            _, a, b = _merged(np.asarray(marks), np.zeros(len(marks), np.int64), w)
            ends = np.r_[s, len(buf)]
            data, kept, last = buf.tobytes(), [], 0
            for i, j in zip(a, b):
                kept.append(data[last : ends[i]])
                last = ends[j]
            kept.append(data[last:])
            out.append(b"".join(kept).decode().strip())
        return pd.Series(out, dtype=object)

    hit = F.col(spans).isNotNull()
    left = joined.withColumn(cleaned, F.coalesce(cut(F.when(hit, F.col("text")), F.col(spans)), F.col("text"))).where(~hit | (F.col(cleaned) != ""))
    out = {"text": F.col(cleaned)}
    if "n_chars" in names:
        out["n_chars"] = F.when(hit, F.length(cleaned).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.select(*(out.get(c, quoted(c)).alias(c) for c in names))
