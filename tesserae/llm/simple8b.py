"""Token ids as binary: Simple-8b word-aligned coding.

A 64-bit word is a selector (top 4 bits) and as many ids as fit with equal
widths; the encoder takes the selector that packs most.  Selector 0 is the escape: the next
word is one value of 2**60 or more, as it is.  Every row is cut into blocks of
BLOCK ids; the offset of each block's first word lets a reader decode any block, or
all blocks side by side.

Layout: little-endian words, block after block.  The last word of a block may
hold fewer ids than its selector says; the number of ids is stored with the row.

Defined results: null text gives null payload, null offsets and n_tokens 0; the empty
text an empty payload.  Whole texts are coded, however long.  Repeated rows each have their result.  An empty table gives an empty one.
Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.bpe import RANKS, _doc_text, ranges, read_ranks
from tesserae.llm.shared import tidy
from tesserae.llm.text import chunks

BLOCK = 128
#: (ids in a word, bits of each) by selector.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
U = np.uint64
SCHEMA = "n_tokens int, payload binary, block_offsets array<int>"


def encode(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows, the rows' word offsets, the blocks' word offsets within their row, the rows' block offsets."""
    ids = ids.astype(np.uint64)
    n = np.diff(off)
    per_row = -(-n // BLOCK)
    row_block = np.r_[0, np.cumsum(per_row)]
    blocks = int(row_block[-1])
    size = np.full(blocks, BLOCK)
    full = per_row > 0
    size[row_block[1:][full] - 1] = n[full] - (per_row[full] - 1) * BLOCK
    grid = np.zeros((blocks, BLOCK), np.uint64)
    grid[np.arange(BLOCK) < size[:, None]] = ids
    bits = np.zeros(grid.shape, np.uint8)
    big = grid >> U(52) > 0
    bits[~big] = np.frexp(grid[~big].astype(np.float64))[1]
    bits[big] = np.frexp((grid[big] >> U(12)).astype(np.float64))[1] + 12
    pick = np.zeros(grid.shape, np.uint8)
    top, have = bits, 1
    most = {1: bits}
    for count in sorted({c for c, _ in SELECTORS} - {1}):
        while have < count:
            step = min(have, count - have)
            moved = np.zeros_like(top)
            moved[:, : BLOCK - step] = top[:, step:]
            top, have = np.maximum(top, moved), have + step
        most[count] = top
    for s in range(len(SELECTORS) - 1, 0, -1):
        count, width = SELECTORS[s]
        pick[most[count] <= width] = s
    counts = np.array([c for c, _ in SELECTORS])
    live, at, step, found = np.flatnonzero(size > 0), np.zeros(blocks, np.int64), 0, []
    while len(live):
        s = pick[live, at[live]]
        found.append((live, at[live].copy(), s, np.full(len(live), step)))
        at[live] += counts[s]
        live, step = live[at[live] < size[live]], step + 1
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64), row_block
    block, pos, sel, step = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((step, block))
    block, pos, sel = block[order], pos[order], sel[order]
    place = np.r_[0, np.cumsum(1 + (sel == 0))]
    words = np.zeros(place[-1], np.uint64)
    wide = np.pad(grid, ((0, 0), (0, 128)))
    for s, (count, width) in enumerate(SELECTORS):
        at = np.flatnonzero(sel == s)
        if not len(at):
            continue
        if s == 0:
            words[place[at] + 1] = grid[block[at], pos[at]]
            continue
        word = np.full(len(at), U(s) << U(60))
        for k in range(count if width else 0):
            word |= wide[block[at], pos[at] + k] << U(k * width)
        words[place[at]] = word
    first = place[np.searchsorted(block, np.arange(blocks + 1))]
    row_word = first[row_block]
    return words, row_word, first[:-1] - np.repeat(row_word[:-1], per_row), row_block


def decode(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at words[first] and hold `size` ids each; all blocks go on together, a word at a time."""
    out, start = np.zeros(int(size.sum()), np.uint64), np.r_[0, np.cumsum(size)]
    at, done, live = first.astype(np.int64).copy(), np.zeros(len(size), np.int64), np.flatnonzero(size > 0)
    while len(live):
        w = words[at[live]]
        sel = (w >> U(60)).astype(np.int64)
        for s in np.unique(sel):
            count, width = SELECTORS[s]
            here = live[sel == s]
            if s == 0:
                at[here] += 1
                out[start[here] + done[here]] = words[at[here]]
            elif width:
                n = np.minimum(count, size[here] - done[here])
                k = ranges(np.zeros(len(here), np.int64), n)
                out[ranges(start[here] + done[here], n)] = (np.repeat(w[sel == s], n) >> (k * width).astype(np.uint64)) & U((1 << width) - 1)
            at[here] += 1
            done[here] += np.minimum(count, size[here] - done[here])
        live = live[done[live] < size[live]]
    return out


def decode_row(payload: bytes, offsets: list[int], n: int) -> np.ndarray:
    first = np.asarray(offsets, np.int64)
    size = np.full(len(first), BLOCK)
    if len(first):
        size[-1] = n - BLOCK * (len(first) - 1)
    return decode(np.frombuffer(payload, "<u8"), first, size)


def token_binary(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, payload, block_offsets) of every row: its byte-level BPE ids in Simple-8b words."""
    ranks = read_ranks(docs, path)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _tiktoken(ranks.value)
        for batch in batches:
            for i, j in chunks(batch.column(1), 1 << 20):
                col = batch.column(1).slice(i, j - i)
                null = np.asarray(col.is_null())
                rows = [encoding.encode_to_numpy(x, disallowed_special=()) for x in col.fill_null("").to_pylist()]
                off = np.r_[0, np.cumsum([len(x) for x in rows])]
                words, row_word, block_word, row_block = encode(np.concatenate(rows) if rows else np.zeros(0, np.uint32), off)
                data = pa.py_buffer(np.ascontiguousarray(words.astype("<u8")))
                payload = pa.Array.from_buffers(pa.binary(), j - i, [_bitmap(null), pa.py_buffer((row_word * 8).astype(np.int32)), data])
                blocks = pa.ListArray.from_arrays(pa.array(row_block.astype(np.int32), mask=np.r_[null, False]), pa.array(block_word.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off).astype(np.int32)), payload, blocks], names=["doc_id", "n_tokens", "payload", "block_offsets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _doc_text(docs).mapInArrow(tidy(code), f"doc_id {kind}, {SCHEMA}")


def _bitmap(null: np.ndarray) -> pa.Buffer | None:
    return pa.py_buffer(np.packbits(~null, bitorder="little")) if null.any() else None


_encodings: dict = {}


def _tiktoken(data: bytes):
    if data not in _encodings:
        import base64

        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _encodings.clear()
        _encodings[data] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[data]
