"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Three measures of a text grow with junk and vary among good texts too: ASCII punctuation and
signs for each character, capitals for each character, and repeated words for each word.  For every
(lang, source) a log-bucket quantile sketch of each measure counts values by
bucket ceil(log_GAMMA(x)) (relative error ALPHA, zero apart); sketches merge by
adding counts, so Spark builds them with one partial aggregation, and a language's
sketch is the sum of its sources'.  The upper fence of a measure is
(q75 + FENCE * (q75 - q25)) * (1 + 2 ALPHA), the last for the sketch's error: what counts as junk follows the source's own
distribution alone, and no measure has a cutoff of its own.  A source's quantiles are drawn towards its language's as if it had
PRIOR documents more, distributed as the language is: a source of few documents is judged by its language, one of many by itself, with no step between.
A document is kept if no measure is above its fence.

Defined results: a null text, or one without words, is rejected as "empty".  Null
languages and sources are groups of their own.  Repeated rows count, and are
judged, each.  A value on the fence is kept; where the quantiles are equal, so is one equal to them.  Texts of any length are measured whole.  An empty table
gives an empty one.  Only doc_id, lang, source and text are read, whatever other columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.shared import checkpoint, tidy
from tesserae.llm.text import SPACE, chunks, flat, rows_of, word_hashes, words

ALPHA, FENCE, PRIOR = 0.01, 4.0, 20
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: In the order in which they name the reason.
MEASURES = ("punct", "capitals", "repeats")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars.encode())] = 1
    return t


_PUNCT, _CAPITAL = _table("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _repeated(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of each row's words are later copies of another, and how many words there are."""
    s, e, off = words(b, o, SPACE)
    row = rows_of(off)
    h = word_hashes(b, s, e)
    order = np.lexsort((h, row))
    h, row_ = h[order], row[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row_[1:] == row_[:-1])
    return np.bincount(row_[again], minlength=len(o) - 1), np.diff(off)


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, and the measures) of every row; in one pass over the texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(3)):
                part = batch.slice(i, j - i)
                b, o = flat(part.column(3))
                chars = np.r_[0, np.cumsum((b & 0xC0) != 0x80)][o]
                size = np.maximum(np.diff(chars), 1)
                share = [np.diff(np.r_[0, np.cumsum(t[b])][o]) / size for t in (_PUNCT, _CAPITAL)]
                again, n = _repeated(b, o)
                cols = [n, *share, again / np.maximum(n, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, cols)], names=["doc_id", "lang", "source", "n_words", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = docs.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    return cols.mapInArrow(tidy(measure), f"doc_id {kind}, lang string, source string, n_words long, " + ", ".join(f"{m} double" for m in MEASURES))


def bucket(x: F.Column) -> F.Column:
    return F.when(x <= 0, F.lit(-1_000_000)).otherwise(F.ceil(F.log(x) / math.log(GAMMA)).cast("int"))


def value(b: F.Column) -> F.Column:
    return F.when(b == -1_000_000, 0.0).otherwise(F.pow(F.lit(GAMMA), b) * (2 / (1 + GAMMA)))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketches of every language and source."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES)))
    return rows.where("n_words > 0").select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], qs: dict[str, float]) -> DataFrame:
    """Quantiles of merged sketches: the value at rank floor(q * (n - 1)); and n."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = {k: F.min(F.when(F.col("upto") > F.floor(q * (F.col("total") - 1)), F.col("bucket"))) for k, q in qs.items()}
    return run.groupBy(*by, "measure").agg(F.first("total").alias("total"), *(value(b).alias(k) for k, b in at.items()))


def thresholds(sketch: DataFrame, fence: float = FENCE, prior: int = PRIOR) -> DataFrame:
    """(lang, source, <measure>_max ...) for every language and source."""
    qs = {"q25": 0.25, "q75": 0.75}
    own = quantiles(sketch, ["lang", "source"], qs)
    of = quantiles(sketch, ["lang"], qs).select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("q25").alias("l25"), F.col("q75").alias("l75"))
    both = own.join(of, own.lang.eqNullSafe(of.l) & (own.measure == of.m))
    low, high = ((F.col("total") * F.col(a) + prior * F.col(b)) / (F.col("total") + prior) for a, b in (("q25", "l25"), ("q75", "l75")))
    top = both.select("lang", "source", "measure", ((high + fence * (high - low)) * (1 + 2 * ALPHA)).alias("top"))
    return top.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col("top"))).alias(f"{m}_max") for m in MEASURES))


def judge(docs: DataFrame, fence: float = FENCE, prior: int = PRIOR) -> DataFrame:
    """(doc_id, keep, reason) of every row; the reason is null for kept ones, else "empty" or the first measure above its fence."""
    rows = checkpoint(measures(docs))
    t = thresholds(sketches(rows), fence, prior)
    t = t.select(F.col("lang").alias("l"), F.col("source").alias("s"), *(f"{m}_max" for m in MEASURES))
    joined = rows.join(t, rows.lang.eqNullSafe(t.l) & rows.source.eqNullSafe(t.s), "left")
    reason = F.when(F.col("n_words") == 0, "empty")
    for m in MEASURES:
        reason = reason.when(F.col(m) > F.col(f"{m}_max"), m)
    return joined.select("doc_id", reason.isNull().alias("keep"), reason.alias("reason"))
