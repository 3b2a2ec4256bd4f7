"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of 1 to 3 characters of labelled texts per language
in BUCKETS buckets, as one distributed aggregation over all labelled rows; the counts of a
task travel in SLICES slices, so that no task of their sums holds more than one slice of a language.  The log-probability matrix,
languages x BUCKETS of float32, is broadcast; more than LANGS labels are an error, so it has 32 MB at most at any scale.  Scoring adds
up the columns of a batch's n-grams with numpy.

A text is accepted if the posterior of its best language is at least POSTERIOR
and the mean log-likelihood ratio of its n-grams to a uniform distribution reaches
the cut of that language: KEPT of the ratio that all but the lowest LOW of its labelled texts have, by a histogram of all of them in steps of 1 / STEPS.  Encoded
data, code and texts in languages far from all known ones are below it; relatives of a known language may not be.
A language of few training texts has a less certain cut.

Defined results: a text that is null or has no letters has lang_pred null,
confidence 0 and is rejected.  Equal posteriors give the language that sorts
first.  Without labelled rows every text is rejected; the empty table gives an empty one.  Repeated rows each have
their result.  Texts of any length are scored whole.  Other columns, whatever their names, are passed on; the three new ones
get underscores behind if there are such columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import release, tidy, tidy_group
from tesserae.llm.text import chunks, flat, fresh, mix, quoted

BUCKETS = 1 << 15
SLICES = 16
LANGS = 256
POSTERIOR = 0.5
LOW, KEPT = 0.001, 0.7  # share of a language's training texts below its quantile, and the cut as a share of that
STEPS = 4096
U = np.uint64
_keep: dict = {}


def _letters() -> np.ndarray:
    """Lower-case form of every letter as a code point; 32 for anything else."""
    if "letters" not in _keep:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x30000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _keep["letters"] = t
    return _keep["letters"]


def _code_points(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cp = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.r_[0, np.cumsum((b & 0xC0) != 0x80)]
    return _letters()[cp], lead[o]


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all rows, and the row of each.  Characters but letters are blanks; n-grams don't reach over two blanks or rows."""
    cp, off = _code_points(*flat(col))
    n = len(cp)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    letter = cp != 32
    x = cp.astype(np.uint64)
    out, rows = [], []
    with np.errstate(over="ignore"):
        for k in (1, 2, 3):
            m = n - k + 1
            if m <= 0:
                continue
            h = x[:m].copy()
            ok = letter[:m].copy() if k == 1 else letter[1 : m + 1].copy()  # the middle of three is a letter, or the second of two
            for i in range(1, k):
                h = h * U(0x100000001B3) + x[i : m + i]
            if k > 1:
                ok &= row[:m] == row[k - 1 :]
            at = np.flatnonzero(ok)
            out.append((mix(h[at] + U(k << 56)) & U(BUCKETS - 1)).astype(np.int32))
            rows.append(row[at])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _labelled(docs: DataFrame, label: str) -> DataFrame:
    """The texts that have a label, as lang and text."""
    data = docs.select(quoted(label).cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    if data.select("lang").distinct().limit(LANGS + 1).count() > LANGS:
        raise ValueError(f"more than {LANGS} languages in the labelled rows")
    return data


def train(docs: DataFrame, label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and their log probabilities (languages x BUCKETS) with priors in column BUCKETS."""
    return _train(_labelled(docs, label))


def _train(data: DataFrame) -> tuple[list[str], np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for a, b in chunks(batch.column(1), 512 << 10):
                g, row = grams(batch.column(1).slice(a, b - a))
                names = np.array(batch.column(0).slice(a, b - a).to_pylist(), object)
                for name in set(names):
                    of = names == name
                    total[name] = total.get(name, np.zeros(BUCKETS, np.int64)) + np.bincount(g[of[row]], minlength=BUCKETS)
                    texts[name] = texts.get(name, 0) + int(of.sum())
        for name, counts in total.items():
            parts = np.split(counts.astype("<i8"), SLICES)
            yield pa.RecordBatch.from_pydict({"lang": [name] * SLICES, "slice": pa.array(range(SLICES), pa.int32()), "n": [texts[name]] * SLICES, "counts": [p.tobytes() for p in parts]})

    sums: dict[str, np.ndarray] = {}
    priors: dict[str, int] = {}
    kind = "lang string, slice int, n long, counts binary"
    for r in data.mapInArrow(tidy(count), kind).groupBy("lang", "slice").applyInArrow(tidy_group(_add), kind).collect():
        of = sums.setdefault(r.lang, np.zeros((SLICES, BUCKETS // SLICES), np.int64))
        of[r.slice], priors[r.lang] = np.frombuffer(r.counts, "<i8"), r.n
    sums = {k: v.ravel() for k, v in sums.items()}
    langs = sorted(sums)
    matrix = np.zeros((len(langs), BUCKETS + 1), np.float32)
    for i, lang in enumerate(langs):
        c = sums[lang] + 0.5
        matrix[i, :BUCKETS] = np.log(c / c.sum())
        matrix[i, BUCKETS] = np.log(priors[lang] / sum(priors.values()))
    return langs, matrix


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS // SLICES, np.int64)
    for x in table["counts"]:
        total += np.frombuffer(x.as_buffer(), "<i8")
    return pa.table({"lang": [table["lang"][0].as_py()], "slice": table["slice"].slice(0, 1), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "counts": [total.tobytes()]})


def score(matrix: np.ndarray, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language by number (-1: none), its posterior, and the mean log likelihood ratio of an n-gram to the uniform distribution."""
    n = len(col)
    g, row = grams(col)
    size = np.bincount(row, minlength=n)
    if not len(matrix):
        return np.full(n, -1), np.zeros(n), np.zeros(n)
    total = np.stack([np.bincount(row, weights=w[:BUCKETS][g], minlength=n) for w in matrix], 1)
    joint = total + matrix[:, BUCKETS]
    best = joint.argmax(1)
    posterior = 1 / np.exp(np.minimum(joint - joint.max(1, keepdims=True), 0)).sum(1)
    ratio = total[np.arange(n), best] / np.maximum(size, 1) + np.log(BUCKETS)
    none = size == 0
    best[none], posterior[none], ratio[none] = -1, 0, 0
    return best, posterior, ratio


def cuts(data: DataFrame, langs: list[str], model) -> np.ndarray:
    """The least mean log likelihood ratio that is accepted as each language, from all labelled texts (lang, text) of which the broadcast model says what their label says.

    Ratios are rounded down to steps; tasks count the texts of each, so what is shuffled is bounded by the number of steps.
    """

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for a, b in chunks(batch.column(1), 512 << 10):
                best, _, ratio = score(model.value, batch.column(1).slice(a, b - a))
                label = batch.column(0).slice(a, b - a).to_pylist()
                seen.update((x, k) for x, i, k in zip(label, best.tolist(), np.floor(ratio * STEPS).astype(np.int64).tolist()) if i >= 0 and langs[i] == x)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in seen], pa.string()), "step": pa.array([k for _, k in seen], pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    def low(table: pa.Table) -> pa.Table:
        step, n = table["step"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(step)
        upto = np.cumsum(n[order])
        at = np.searchsorted(upto, int(LOW * (upto[-1] - 1)), "right")
        return pa.table({"lang": table["lang"].slice(0, 1), "low": [float(step[order][at]) / STEPS]})

    counts = data.mapInArrow(tidy(steps), "lang string, step long, n long").groupBy("lang", "step").agg(F.sum("n").alias("n"))
    least = {r.lang: r.low for r in counts.groupBy("lang").applyInArrow(tidy_group(low), "lang string, low double").collect()}
    return np.array([max(0.0, KEPT * least.get(x, 0.0)) for x in langs])


def identify(docs: DataFrame, label: str = "lang") -> DataFrame:
    """The columns of docs with lang_pred, confidence and accepted appended (under names with underscores behind if docs has such columns)."""
    data = _labelled(docs, label)
    langs, matrix = _train(data)
    model = docs.sparkSession.sparkContext.broadcast(matrix)
    cut = np.r_[cuts(data, langs, model), 0.0]  # the last for no language
    names = np.array([*langs, None], object)

    @F.arrow_udf("lang_pred string, confidence double, accepted boolean")
    def judged(text: pa.Array) -> pa.Array:
        parts = [score(model.value, text.slice(a, b - a)) for a, b in chunks(text, 512 << 10)]
        best, posterior, ratio = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0), np.zeros(0))
        accepted = (best >= 0) & (posterior >= POSTERIOR) & (ratio > 0) & (ratio >= cut[best])
        release()
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(np.round(posterior, 6)), pa.array(accepted)], names=["lang_pred", "confidence", "accepted"])

    hidden = fresh(docs.columns, "judged")
    out = docs.withColumn(hidden, judged(F.col("text").cast("string")))
    new = [F.col(f"{hidden}.{c}").alias(fresh(docs.columns, c)) for c in ("lang_pred", "confidence", "accepted")]
    return out.select(*map(quoted, docs.columns), *new)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, as they are."""
    accepted = fresh(docs.columns, "accepted")
    return identify(docs).where(F.col(accepted)).select(*map(quoted, docs.columns))
