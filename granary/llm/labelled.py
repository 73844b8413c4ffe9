"""Labelled rows for the classifiers, and small model helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def labels_of(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(column).alias("label"))


def bounded_sample(labels: DataFrame, learn: Column, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most about ``most`` labelled ids that may be learned from, chosen by a hash of the id.

    Null labels are left out; ids with several labels count as 1 if at least half of them are 1.
    """
    usable = labels.filter(learn & F.col("label").isNotNull()).groupBy(id_col).agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    n = usable.count()
    if n > most:
        usable = usable.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / n)))
    return usable


def labelled_texts(df: DataFrame, labels: DataFrame, id_col: str, text: str, most_rows: int, most_bytes: int, buckets: int = 4096) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the rows whose ids are labelled, in the order of a hash, within bounds of rows and bytes.

    Rows equal in id and text count once. Rows are dealt into buckets by the hash; only the buckets' sizes come to the
    driver before the texts, and the buckets from the first on are taken as long as they fit.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id_col).alias("i"), t.alias("t")).join(F.broadcast(labels.select(F.col(id_col).alias("i"), "label")), "i")
    rows = rows.groupBy("i", F.xxhash64("i", "t").alias("h")).agg(F.first("t").alias("t"), F.first("label").alias("label"))
    rows = rows.withColumn("b", F.pmod("h", F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("s")).orderBy("b").collect()
    n = size = upto = 0
    for r in sizes:
        n, size = n + r["n"], size + r["s"]
        if n > most_rows * 1.1 or size > most_bytes:
            break
        upto = r["b"] + 1
    found = rows.filter(F.col("b") < upto).orderBy("b", "h").select("t", "label").toPandas()
    return found["t"].tolist(), found["label"].to_numpy(int)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_sparse_logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, y: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on targets in [0, 1], by Adam over the entries that aren't 0."""
    w, n = np.zeros(width + 1), len(y)
    m, v = np.zeros_like(w), np.zeros_like(w)
    penalty = np.r_[np.full(width, l2), 1e-6]
    for t in range(1, steps + 1):
        off = sigmoid(np.bincount(rows, values * w[columns], n) + w[-1]) - y
        g = (np.r_[np.bincount(columns, values * off[rows], width), off.sum()] + penalty * w) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 300, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on targets in [0, 1]: Newton steps for few columns, else Adam."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.r_[np.full(x.shape[1] - 1, l2), 1e-6]
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    if x.shape[1] <= 64:
        for _ in range(40):
            p = sigmoid(x @ w)
            gradient = x.T @ (weight * (p - y)) + penalty * w
            hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = (x.T @ (weight * (sigmoid(x @ w) - y)) + penalty * w) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
