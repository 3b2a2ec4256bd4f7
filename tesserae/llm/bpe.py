"""Byte-level BPE over a rank file: encoding by prefix dynamic programming, decoding, and token counts by heap merging.

Text is cut into pretokens by numpy passes over character classes (the public
pattern of the rank files).  Pretokens repeat, so each distinct one of a batch
is worked on once; ids and counts are then gathered for all occurrences.

Prefix dynamic programming: every prefix of a pretoken has exactly one valid
last token, the t that ends the prefix such that t follows the last token of
what is before it as a valid pair (the merges leave the pair as it is).  The
array of last tokens gives the encoding backwards, can be extended by appended
bytes without looking at earlier ones, and is unchanged before an edit.

The rank file's path is a parameter (RANKS, or the environment's TESSERAE_RANKS, if it isn't given); the driver reads it, and its bytes
reach the executors as a broadcast of fixed size.

Defined results: null text has null ids and count 0; the empty text has no
tokens.  Texts of any length are encoded whole.  Repeated rows each have their
result.  Only doc_id and text are read, whatever other columns are called.  An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.shared import tidy
from tesserae.llm.text import chunks, flat, mix, powers, word_hashes
from tesserae.llm.text import _BYTE, _P, _PI  # the rolling hash of words

RANKS = os.environ.get("TESSERAE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
LONG = 192
U = np.uint64
_state: dict = {}


def _classes() -> np.ndarray:
    """Class of every code point."""
    if "classes" not in _state:
        import regex

        text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
        kind = np.full(0x110000, OTHER, np.uint8)
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, text):
                kind[m.start() : m.end()] = value
        _state["classes"] = kind
    return _state["classes"]


def byte_classes(b: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of valid UTF-8 belongs to."""
    kinds = _classes()
    out = kinds[:256][b]
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        c = b[lead].astype(np.int32)
        n = 1 + (c >= 0xE0) + (c >= 0xF0)
        x = [b[np.minimum(lead + k, len(b) - 1)].astype(np.int32) & 63 for k in (1, 2, 3)]
        cp = np.where(n == 1, (c & 31) << 6 | x[0], np.where(n == 2, (c & 15) << 12 | x[0] << 6 | x[1], (c & 7) << 18 | x[0] << 12 | x[1] << 6 | x[2]))
        kind = kinds[cp]
        out[lead] = kind
        for k in (1, 2, 3):
            at = n >= k
            out[lead[at] + k] = kind[at]
    return out


def pretokens(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pretokens (each ends where the next starts), and the offsets of the rows' pretokens."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(o), np.int64)
    kind = byte_classes(b)
    edge = np.zeros(n + 1, bool)
    edge[o] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[n] = True
    at = np.flatnonzero(run)  # starts of runs of one class, and the end
    begin, end, of = at[:-1], at[1:], kind[at[:-1]]
    mark = np.zeros(n + 1, bool)
    mark[begin] = True
    # of white space before other text, the last character stands alone, or joins what follows if it is a blank
    space = np.flatnonzero((of == SPACE) & ~edge[end])
    last = end[space] - 1
    while len(back := np.flatnonzero((b[last] & 0xC0) == 0x80)):
        last[back] -= 1
    mark[last] = True
    blank = b[last] == 32
    mark[end[space][blank]] = False
    joined = np.zeros(n + 1, bool)
    joined[end[space][blank]] = True
    # contractions: an apostrophe by itself that starts a match
    q = np.flatnonzero((of == OTHER) & (end - begin == 1) & (b[begin] == 39) & ~joined[begin] & ~edge[end])
    q = q[of[q + 1] == LETTER] if len(q) else q
    for i in q:
        s = begin[i] + 1
        word = b[s : min(s + 2, end[i + 1])].tobytes()
        size = 2 if word in (b"re", b"ve", b"ll") else 1 if word[:1] in (b"s", b"t", b"m", b"d") else 0
        if size:
            mark[s] = False
            if s + size < end[i + 1]:
                mark[s + size] = True
    starts = np.flatnonzero(mark[:n])
    return starts, np.searchsorted(starts, o)


class Vocabulary:
    """Ranks as arrays: token bytes, split of every token into the pair that makes it, and hash tables of tokens and pairs."""

    def __init__(self, data: bytes):
        self.tokens: list[bytes] = []
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, data.splitlines()) if t)
        size = pairs[-1][0] + 1
        self.tokens = [b""] * size
        for r, t in pairs:
            self.tokens[r] = t
        self.rank = {t: r for r, t in pairs}
        self.longest = max(map(len, self.rank))
        self.left, self.right = np.arange(size), np.arange(size)
        for r, t in pairs:
            if len(t) > 1:
                parts = merge(t, self.rank, r)
                if len(parts) == 2:
                    self.left[r], self.right[r] = parts
        ids = np.array([r for r, _ in pairs], np.int64)
        buf = np.frombuffer(b"".join(t for _, t in pairs), np.uint8)
        ends = np.cumsum([len(t) for _, t in pairs])
        lens = np.array([len(t) for _, t in pairs])
        self.of = Lookup(word_hashes(buf, ends - lens, ends), ids)
        two = np.flatnonzero(self.left != self.right)
        two = two[[len(self.tokens[i]) > 1 for i in two]] if len(two) else two
        twin = np.array([i for i in range(size) if len(self.tokens[i]) > 1 and self.left[i] == self.right[i] != i], np.int64)
        made = np.union1d(two, twin)
        self.merged = Lookup(pair_key(self.left[made], self.right[made]), made)
        self.offsets = np.r_[0, np.cumsum([len(t) for t in self.tokens])]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave token a before token b as they are.

        Walks down the splits along the boundary: the pair is invalid if two
        tokens at the boundary, present at one time, would have merged.
        """
        out = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40)
        while len(live):
            m = self.merged.get(pair_key(a, b))
            bad = (m >= 0) & (m < limit)
            out[live[bad]] = False
            go = ~bad
            live, a, b, limit = live[go], a[go], b[go], limit[go]
            right_next, left_next = self.right[a], self.left[b]
            down_a = a > b
            # undo the newer of the two tokens; a token that has no split is a byte: then undo the other one
            na, nb, nl = a.copy(), b.copy(), limit.copy()
            nl[down_a], nl[~down_a] = a[down_a], b[~down_a] + 1
            na[down_a] = right_next[down_a]
            nb[~down_a] = left_next[~down_a]
            stuck_a = down_a & (na == a)
            stuck_b = ~down_a & (nb == b)
            nl[stuck_a], nb[stuck_a] = b[stuck_a] + 1, left_next[stuck_a]
            nl[stuck_b], na[stuck_b] = a[stuck_b], right_next[stuck_b]
            done = (stuck_a & (nb == b)) | (stuck_b & (na == a))
            go = ~done
            live, a, b, limit = live[go], na[go], nb[go], nl[go]
        return out

    def is_valid(self, a: int, b: int) -> bool:
        cache = self.__dict__.setdefault("pairs", {})
        if (a, b) not in cache:
            if len(cache) > 1 << 20:
                cache.clear()
            cache[a, b] = bool(self.valid(np.array([a]), np.array([b]))[0])
        return cache[a, b]


class Lookup:
    """Open-addressing table from 64-bit keys to values, read by whole arrays; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = U((1 << max(4, int(8 * len(keys)).bit_length())) - 1)
        self.keys, self.values = np.zeros(int(self.mask) + 1, np.uint64), np.full(int(self.mask) + 1, -1, np.int64)
        self.probes = 1
        for k, v in zip(keys.tolist(), values.tolist()):
            i, n = k & int(self.mask), 1
            while self.values[i] >= 0:
                i, n = (i + 1) & int(self.mask), n + 1
            self.keys[i], self.values[i], self.probes = k, v, max(self.probes, n)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = (keys & self.mask).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        todo = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & int(self.mask)
            hit = self.keys[at[todo]] == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (self.values[at[todo]] >= 0)]
        return out


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((a.astype(np.uint64) << U(32)) | b.astype(np.uint64))


def merge(text: bytes, rank: dict[bytes, int], below: int) -> list[int]:
    """Byte-pair merging with ranks under `below` only, by repeated scans; for vocabulary entries."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best, at = min((rank.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [rank[p] for p in parts]


def heap_count(text: bytes, rank: dict[bytes, int]) -> int:
    """Number of tokens of one pretoken: its bytes less the merges.

    The symbols are a linked list; a heap has all adjacent pairs that may merge,
    by rank and then position.  Popped pairs of which a side has changed are stale.
    """
    if text in rank:
        return 1
    n = count = len(text)
    end = list(range(1, n + 1))  # of the symbol that starts at i; 0: merged into another
    before = list(range(-1, n - 1))
    get = rank.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, stop = pop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        count -= 1
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(text[i : end[stop]])) is not None:
                push(heap, (r, i, end[stop]))
        if i and (r := get(text[before[i] : stop])) is not None:
            push(heap, (r, before[i], stop))
    return count


class PrefixEncoder:
    """Encoding of one growing or edited pretoken: last[i] is the valid last token of its first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.v, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def append(self, more: bytes) -> PrefixEncoder:
        """Extends the encoding; earlier entries are not looked at again but for their last tokens."""
        v, text, last = self.v, self.text + more, self.last
        for end in range(len(self.text) + 1, len(text) + 1):
            for size in range(min(end, v.longest), 0, -1):
                t = v.rank.get(text[end - size : end])
                if t is not None and (size == end or v.is_valid(last[end - size - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        self.text = text
        return self

    def edit(self, start: int, stop: int, new: bytes) -> PrefixEncoder:
        """Replaces text[start:stop]; entries before start stay."""
        tail = new + self.text[stop:]
        self.text, self.last = self.text[:start], self.last[:start]
        return self.append(tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            out.append(t := self.last[at - 1])
            at -= len(self.v.tokens[t])
        return out[::-1]


def encode_distinct(v: Vocabulary, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pretokens at once, flat, and their offsets; one step of the dynamic programme takes all pretokens' i-th bytes."""
    size = e - s
    count = np.zeros(len(s), np.int64)
    last = np.zeros(len(b), np.int32)
    order = np.argsort(-np.where(size > LONG, 0, size), kind="stable")
    order = order[: int(np.count_nonzero(size <= LONG))]
    so, lo = s[order], size[order]
    with np.errstate(over="ignore"):
        c = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * powers(_P, len(b))[: len(b)], out=c[1:])
    inverse = powers(_PI, len(b) + 1)
    lens = -lo
    for i in range(1, (int(lo[0]) if len(lo) else 0) + 1):
        todo = so[: np.searchsorted(lens, -i, "right")] + i  # ends of the prefixes
        for width in range(min(i, v.longest), 0, -1):
            if not len(todo):
                break
            with np.errstate(over="ignore"):
                h = mix((c[todo] - c[todo - width]) * inverse[todo - width] + U(width))
            t = v.of.get(h)
            hit = np.flatnonzero(t >= 0)
            if not len(hit):
                continue
            if width < i:
                hit = hit[v.valid(last[todo[hit] - width - 1], t[hit])]
            last[todo[hit] - 1] = t[hit]
            rest = np.ones(len(todo), bool)
            rest[hit] = False
            todo = todo[rest]
    for k in np.flatnonzero(size > LONG):
        last[s[k] : e[k]] = PrefixEncoder(v, b[s[k] : e[k]].tobytes()).last
    width = np.diff(v.offsets)
    at, live = e.copy(), np.flatnonzero(size > 0)
    while len(live):  # backwards, to count
        at[live] -= width[last[at[live] - 1]]
        count[live] += 1
        live = live[at[live] > s[live]]
    off = np.r_[0, np.cumsum(count)]
    ids = np.zeros(off[-1], np.int32)
    at, to, live = e.copy(), off[1:].copy(), np.flatnonzero(size > 0)
    while len(live):
        t = last[at[live] - 1]
        to[live] -= 1
        ids[to[live]] = t
        at[live] -= width[t]
        live = live[at[live] > s[live]]
    return ids, off


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    off = np.cumsum(count)
    return np.repeat(start - np.r_[0, off[:-1]], count) + np.arange(off[-1] if len(off) else 0)


def distinct(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each distinct pretoken, and the number of each occurrence's."""
    import pandas as pd

    ends = np.r_[starts[1:], len(b)]
    h = word_hashes(b, starts, ends)
    code, kinds = pd.factorize(h)
    first = np.zeros(len(kinds), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return starts[first], ends[first], kinds, code


def vocabulary(data: bytes) -> Vocabulary:
    """The vocabulary of this rank file, made once in a worker."""
    if _state.get("of") is None or _state["of"][0] != data:
        _state["of"] = (data, Vocabulary(data))
        _state["counts"] = None
    return _state["of"][1]


def encode_rows(v: Vocabulary, b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, flat, and the rows' offsets."""
    starts, po = pretokens(b, o)
    s, e, _, code = distinct(b, starts)
    ids, off = encode_distinct(v, b, s, e)
    n = np.diff(off)[code]
    return ids[ranges(off[:-1][code], n)], np.r_[0, np.cumsum(n)][po]


def decode_rows(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, flat, and the rows' offsets."""
    n = np.diff(v.offsets)[ids]
    return v.bytes[ranges(v.offsets[:-1][ids], n)], np.r_[0, np.cumsum(n)][off]


def read_ranks(docs: DataFrame, path: str):
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no rank file at {path!r}; give its path, or name it in TESSERAE_RANKS")
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _doc_text(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def bpe_encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, ids, round_trip): the token ids of every row, and whether decoding them gives the row's bytes."""
    ranks = read_ranks(docs, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks.value)
        for batch in batches:
            for i, j in chunks(batch.column(1), 8 << 20):
                col = batch.column(1).slice(i, j - i)
                b, o = flat(col)
                ids, off = encode_rows(v, b, o)
                back, bo = decode_rows(v, ids, off)
                if len(back) == len(b) and np.array_equal(bo, o):
                    bad = np.unique(np.searchsorted(o, np.flatnonzero(back != b), "right") - 1)
                    good = np.ones(j - i, bool)
                    good[bad] = False
                else:
                    good = np.array([np.array_equal(back[bo[k] : bo[k + 1]], b[o[k] : o[k + 1]]) for k in range(j - i)], bool)
                null = np.asarray(col.is_null())
                offsets = pa.array(off.astype(np.int32), mask=np.r_[null, False])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(good, mask=null)], names=["doc_id", "ids", "round_trip"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _doc_text(docs).mapInArrow(tidy(encode), f"doc_id {kind}, ids array<int>, round_trip boolean")


def bpe_decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null, and so do lists with a null or an id outside the vocabulary in them; bytes that aren't UTF-8 become U+FFFD."""
    ranks = read_ranks(encoded, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks.value)
        for batch in batches:
            known = len(v.tokens)
            out = [None if x is None or any(t is None or not 0 <= t < known for t in x) else b"".join(v.tokens[t] for t in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(tidy(decode), f"doc_id {kind}, text string")


KEPT = 4_000_000


def _counted(v: Vocabulary, b: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Token counts of distinct pretokens.  The worker remembers up to KEPT of them; that only saves time."""
    out = np.full(len(h), -1, np.int32)
    if _state.get("counts") is not None:
        keys, values = _state["counts"]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        out[hit] = values[at[hit]]
    data, rank = b.tobytes(), v.rank
    new = np.flatnonzero(out < 0)
    out[new] = [heap_count(data[i:j], rank) for i, j in zip(s[new].tolist(), e[new].tolist())]
    if len(new):
        keys, values = (h[new], out[new]) if _state.get("counts") is None else (np.r_[_state["counts"][0], h[new]], np.r_[_state["counts"][1], out[new]])
        if len(keys) > KEPT:
            keys, values = h[new], out[new]
        order = np.argsort(keys)
        _state["counts"] = (keys[order], values[order])
    return out


def token_counts(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens) of every row, without identifiers."""
    ranks = read_ranks(docs, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks.value)
        for batch in batches:
            for i, j in chunks(batch.column(1), 16 << 20):
                b, o = flat(batch.column(1).slice(i, j - i))
                starts, po = pretokens(b, o)
                s, e, h, code = distinct(b, starts)
                total = np.r_[0, np.cumsum(_counted(v, b, s, e, h)[code], dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(total[po]))], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _doc_text(docs).mapInArrow(tidy(count), f"doc_id {kind}, n_tokens long")
