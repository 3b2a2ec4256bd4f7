"""Matrix sets made of the sample tables, and file adapters."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ["l_quantity", "100 * l_discount", "l_extendedprice / 1000", "100 * l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def covariance_by(df: DataFrame, key: str, channels: list[str], least: int = 12, ddof: int = 0) -> DataFrame:
    """(id, n, cov): covariance of SQL expressions within each key of `least` rows or more; one shuffle, partial aggregation on both sides of it."""
    f = F.covar_samp if ddof else F.covar_pop
    cs = [f"__c{i}" for i in range(len(channels))]
    rows = df.select(F.col(key).alias("id"), *(F.expr(c).alias(a) for c, a in zip(channels, cs)))
    pair = {(i, j): f(cs[i], cs[j]).alias(f"__{i}_{j}") for i in range(len(cs)) for j in range(i, len(cs))}
    agg = rows.groupBy("id").agg(F.count("*").alias("n"), *pair.values()).where(F.col("n") >= least)
    return agg.select("id", "n", F.array(*(f"__{min(i, j)}_{max(i, j)}" for i in range(len(cs)) for j in range(len(cs)))).alias("cov"))


def part_cov(spark, sf_dir, p=2, ddof=0):
    """One p x p covariance (p up to 4) for each part with 12 lines or more."""
    return covariance_by(table(spark, sf_dir, "lineitem"), "l_partkey", CHANNELS[:p], ddof=ddof)


def part_labels(spark, sf_dir, p=2):
    """part_cov with the part's brand as y and its price as target."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("y"), F.col("p_retailprice").alias("target"), "p_size")
    return part_cov(spark, sf_dir, p).join(part, "id")


def supplier_cov(spark, sf_dir, p=2):
    """One covariance for each supplier, with nation as y, region as domain and balance as target."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    who = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("y"), F.col("r_name").alias("domain"), F.col("s_acctbal").alias("target"))
    return covariance_by(table(spark, sf_dir, "lineitem"), "l_suppkey", CHANNELS[:p]).join(who, "id")


def embedding_epochs(spark, sf_dir):
    """Each 64-vector as an epoch of 8 channels x 8 samples, with its label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("x"))


def order_series(spark, sf_dir, length=8):
    """For each customer with enough orders the last `length` totals in order of date, as one channel."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = o.select("o_custkey", "o_totalprice", F.row_number().over(w).alias("k")).where(F.col("k") <= length)
    g = last.groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(-F.col("k"), F.col("o_totalprice") / 1000)), True).alias("s"))
    return g.where(F.size("s") == length).select("id", F.transform("s", lambda v: v["col2"]).alias("x"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """.npy files of shape (n, p, p) as (path, id, cov)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.load(io.BytesIO(data), allow_pickle=False)
                yield pa.RecordBatch.from_pydict({"path": [name] * len(x), "id": np.arange(len(x)), "cov": [r.ravel().tolist() for r in x.astype(float)]})

    return files.mapInArrow(run, "path string, id long, cov array<double>")


def read_signal_csv(spark: SparkSession, path: str, channels: list[str], key: str = "epoch", t: str = "t", header: bool = True) -> DataFrame:
    """Long text (gzip too): a row for each sample with epoch, t and the channels; gives (id, x) with times in order."""
    schema = f"{key} long, {t} double, " + ", ".join(f"`{c}` double" for c in channels)
    return long_to_epochs(spark.read.csv(path, schema=schema, header=header), channels, key, t)


def long_to_epochs(df: DataFrame, channels: list[str], key: str = "epoch", t: str = "t") -> DataFrame:
    g = df.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct(t, *channels))).alias("s"))
    return g.select("id", F.concat(*(F.col("s")[c] for c in channels)).alias("x"))


def epochs_to_long(df: DataFrame, channels: int, col: str = "x") -> DataFrame:
    """(id, t, c0, c1, ...) of epochs."""
    n = (F.size(col) / channels).cast("int")
    rows = df.select("id", col, n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("t"))
    return rows.select("id", "t", *(F.col(col)[F.col("t") + F.col("n") * c].alias(f"c{c}") for c in range(channels)))


def save_matrices(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)
