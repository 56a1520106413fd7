"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, groups.

A vector lives in the cell of its nearest centroid and visits every cell whose centroid is nearly as
near. A pair is found if one vector visits the home of the other, so only pairs that a cell border
parts by more than ``MARGIN`` can be missed. Each pair is looked at in one home only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribospark.llm.bitslice import forest
from tribospark.llm.components import components
from tribospark.session import materialise

#: Rows of a block; a task multiplies two blocks.
BLOCK = 2048
#: Vectors the centroids are fitted on, at most about; one task holds them.
SAMPLE_ROWS = 16384
#: Vectors a cell should be home to; with more than MAX_CELLS times that, cells get larger.
CELL_ROWS = 512
MAX_CELLS = 2048
ROUNDS = 10
#: A vector visits the cells whose centroid's cosine is at most this far below its home's. Two unit
#: vectors with cosine 0.95 are 0.32 apart; in 64 dimensions that changes the difference of two
#: centroid cosines by 0.06 (standard deviation), so the margin is 2.7 of those.
MARGIN = 0.15


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; the largest component goes first, so none overflows."""
    x = np.asarray(values, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """k unit centroids of the unit rows ``x``; an empty cluster keeps its old centroid."""
    centroids = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])]
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def fit_centroids(distinct: DataFrame, n: int) -> np.ndarray:
    """Centroids fitted in one task on a hash sample of at most about SAMPLE_ROWS vectors."""
    k = max(1, min(MAX_CELLS, n // CELL_ROWS))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec")
        return pd.DataFrame({"centroid": spherical_kmeans(unit(np.stack(frame["v"].to_list())), k).tolist()})

    share = F.pmod(F.xxhash64("vec", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = distinct.where((share < SAMPLE_ROWS / max(n, 1)) | (F.lit(n) <= SAMPLE_ROWS))
    rows = sample.groupBy("size").applyInPandas(fit, "centroid array<double>").collect()  # k <= MAX_CELLS rows
    return np.array([row["centroid"] for row in rows])


def visits(distinct: DataFrame, centroids: np.ndarray, margin: float) -> DataFrame:
    """(vec, n, v, home, cell): a row for the home of each vector and for every cell that it visits."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cosine = unit(np.stack([v.as_py() for v in part.column("v")])) @ centroids.T
                home = cosine.argmax(axis=1)
                row, cell = np.nonzero(cosine >= cosine.max(axis=1, keepdims=True) - margin)
                taken = part.take(pa.array(row))
                columns = [taken.column(c) for c in ("vec", "n", "v")] + [pa.array(home[row]), pa.array(cell)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec", "n", "v", "home", "cell"])

    kind = distinct.schema["v"].dataType.simpleString()
    return distinct.select("vec", "n", "v").mapInArrow(assign, f"vec bigint, n bigint, v {kind}, home bigint, cell bigint")


def cell_links(visiting: DataFrame, threshold: float) -> DataFrame:
    """(a, links, b): for each block pair, the rows linked to a vector, and a spanning forest's edges.

    The cell's own vectors are cut into blocks, and so are its visitors; a task multiplies a home block
    with one other block. A visitor from a cell that a vector also visits would be met twice; the pair
    counts in the smaller of the two homes then, which the task tells by the two lists of cells.
    """
    sizes = (
        visiting.groupBy("cell")
        .agg(F.count_if(F.col("home") == F.col("cell")).alias("own"), F.count("*").alias("all"))
        .where((F.col("own") > 0) & (F.col("all") > 1))
    )
    cells = visiting.groupBy("vec").agg(F.collect_list("cell").alias("cells"))  # MAX_CELLS at most
    member = F.col("home") == F.col("cell")
    n_own = F.ceil(F.col("own") / BLOCK).cast("int")
    n_rest = F.ceil((F.col("all") - F.col("own")) / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("vec", F.lit(3)), F.when(member, n_own).otherwise(F.greatest(n_rest, F.lit(1)))).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    own_pairs = F.transform(every(F.col("n_own")), lambda o: pair(F.least("mine", o), F.greatest("mine", o)))
    rest_pairs = F.when(
        F.col("n_rest") > 0, F.transform(every(F.col("n_rest")), lambda r: pair(F.col("mine"), F.col("n_own") + r))
    ).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    from_rest = F.transform(every(F.col("n_own")), lambda o: pair(o, F.col("n_own") + F.col("mine")))
    dealt = (
        visiting.join(cells, "vec")
        .join(sizes, "cell")
        .withColumns({"member": member, "mine": mine, "n_own": n_own, "n_rest": n_rest})
        .withColumn("pair", F.explode(F.when(F.col("member"), F.concat(own_pairs, rest_pairs)).otherwise(from_rest)))
        .select("cell", "home", "cells", "vec", "n", "v", "member", "mine", "n_own", "pair.i", "pair.j")
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec", kind="stable").reset_index(drop=True)
        first = frame.iloc[0]
        i, j, cell = int(first["i"]), int(first["j"]), int(first["cell"])
        member, mine = frame["member"].to_numpy(), frame["mine"].to_numpy()
        x = unit(np.stack(frame["v"].to_list()))
        left = np.nonzero(member & (mine == i))[0]
        right = np.nonzero(member & (mine == j) if j < first["n_own"] else ~member)[0]
        n, homes = frame["n"].to_numpy(), frame["home"].to_numpy()
        lists = frame["cells"]
        count = np.zeros(len(frame), np.int64)
        ends = []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            p, q = np.nonzero(x[some] @ x[right].T >= threshold)
            p, q = some[p], right[q]
            if i == j:
                keep = p < q
            else:  # a visitor whose home the vector visits too is met in both homes
                keep = np.ones(len(p), bool)
                for home in np.unique(homes[q][homes[q] < cell]):
                    goes = np.zeros(len(frame), bool)
                    goes[some] = [home in lists[k] for k in some]
                    keep &= ~((homes[q] == home) & goes[p])
            p, q = p[keep], q[keep]
            np.add.at(count, p, n[q])
            np.add.at(count, q, n[p])
            ends.append((p, q))
        a = np.concatenate([e[0] for e in ends]) if ends else np.zeros(0, np.int64)
        b = np.concatenate([e[1] for e in ends]) if ends else np.zeros(0, np.int64)
        root, vec = forest(len(frame), a, b), frame["vec"].to_numpy()
        hit = np.nonzero(count)[0]
        return pd.DataFrame({"a": vec[hit], "links": count[hit], "b": vec[root[hit]]})

    return dealt.groupBy("cell", "i", "j").applyInPandas(compare, "a bigint, links bigint, b bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, margin: float = MARGIN) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors`` (vec_id, embedding).

    n_links counts the other rows with cosine >= threshold; component_id is the smallest vec_id
    reachable over links. Vectors that are null, empty, zero or hold a null, NaN or infinity link with
    nothing; so do vectors of different lengths. Equal vectors are compared once and counted as often as they occur. A null vec_id
    takes part, but names no component. Further columns are ignored.
    """
    v = F.col("embedding")
    sound = F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select("vec_id", F.when(sound, F.transform(v, lambda x: x + F.lit(0).cast("float"))).alias("v"))
    if dict(vectors.dtypes)["embedding"] != "array<float>":
        rows = vectors.select("vec_id", F.when(sound, F.transform(v, lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    known = rows.where(F.col("v").isNotNull())
    distinct = known.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = materialise(distinct.withColumn("vec", F.monotonically_increasing_id()).withColumn("size", F.size("v")))
    parts = []
    for (size, n) in sorted(tuple(r) for r in distinct.groupBy("size").count().collect()):  # one row for each length in use
        same = distinct.where(F.col("size") == size)
        visiting = materialise(visits(same, fit_centroids(same, n), margin))
        parts.append(materialise(cell_links(visiting, threshold)))
    if not parts:
        return rows.select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    links = parts[0]
    for more in parts[1:]:
        links = links.unionByName(more)
    counts = links.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "vec")
    members = components(links.select("a", "b")).withColumnRenamed("node", "vec")
    named = (
        distinct.join(counts, "vec", "left")
        .join(members, "vec", "left")
        .select("v", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "vec").alias("component"))
    )
    low = named.groupBy("component").agg(F.min("least").alias("low"))
    named = named.join(low, "component").select("v", (F.col("links") + F.col("n") - 1).alias("n_links"), "low")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return rows.join(named, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
