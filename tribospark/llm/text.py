"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def byte_values(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text without building str objects; null gives empty bytes."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def text_values(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """An independent 64-bit hash of each 64-bit value (xor-shift-multiply finaliser)."""
    x = values + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, target: str, train: Column, max_rows: int, salt: int = 17
) -> DataFrame:
    """(text, label) of at most about ``max_rows`` labelled training documents.

    A document is taken if a hash of its id falls below max_rows / (labelled training documents), so
    the sample is the same in every run and its size does not grow with the tables. An id labelled
    more than once gets the larger label; null ids and null labels are left out. The taken ids are
    bounded by ``max_rows``, which is why they may be broadcast.
    """
    known = (
        labels.select("doc_id", F.col(target).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    taken = known.where(share < max_rows / max(n, 1))
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(taken), "doc_id"
    )
