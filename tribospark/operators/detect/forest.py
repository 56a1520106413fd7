"""Isolation forest per joint (Liu, Ting and Zhou, 2008)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribospark.operators.detect.common import joint_seed, label_below, matrix, numeric_or, scores_and_values
from tribospark.session import materialise

AUTO_SAMPLES = 256
TREES_PER_TASK = 10
EULER = 0.5772156649015329


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + EULER) - 2 * (m - 1) / m))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Random splits until points are isolated, equal, or the depth limit is reached."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    tree: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "path": []}

    def add(feature=-1, threshold=0.0, path=0.0):
        for key, value in zip(tree, (feature, threshold, -1, -1, path)):
            tree[key].append(value)
        return len(tree["path"]) - 1

    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        index, depth, parent, side = todo.pop()
        low, high = x[index].min(axis=0), x[index].max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= limit or not len(wide):
            node = add(path=depth + float(average_path(len(index))))
        else:
            feature = int(rng.choice(wide))
            threshold = float(rng.uniform(low[feature], high[feature]))
            if threshold >= high[feature]:  # neighbouring doubles: keep both sides non-empty
                threshold = float(low[feature])
            node = add(feature, threshold)
            below = x[index, feature] <= threshold
            todo += [(index[below], depth + 1, node, "left"), (index[~below], depth + 1, node, "right")]
        if parent is not None:
            tree[side][parent] = node
    return tree


def as_arrays(tree: dict) -> dict[str, np.ndarray]:
    """Turns the lists of a tree into arrays, once for each task: the tree keeps them."""
    if isinstance(tree["path"], list):
        tree.update({key: np.asarray(values) for key, values in tree.items()})
    return tree


def mean_path(tree: dict, x: np.ndarray) -> np.ndarray:
    """Path length of each row; all rows descend one level at a time."""
    tree = as_arrays(tree)
    feature, threshold, left, right = tree["feature"], tree["threshold"], tree["left"], tree["right"]
    node, rows = np.zeros(len(x), dtype=int), np.arange(len(x))
    active = rows[feature[node] >= 0]
    while len(active):
        at = node[active]
        node[active] = np.where(x[active, feature[at]] <= threshold[at], left[at], right[at])
        active = active[feature[node[active]] >= 0]
    return tree["path"][node]


def forest_score(model: dict, x: np.ndarray) -> np.ndarray:
    """Minus the anomaly measure 2^(-path/expected): lower is worse."""
    depth = sum(mean_path(tree, x) for tree in model["trees"]) / len(model["trees"])
    return -(2.0 ** (-depth / max(float(average_path(model["samples"])), 1e-12)))


def sample_size(samples: int | float, n: Column) -> Column:
    """Rows for a tree: a number of rows, or a share of the joint's rows (a float of 1 at most)."""
    if isinstance(samples, float) and samples <= 1:
        return F.least(F.greatest(F.floor(n * samples), F.lit(1)), n).cast("int")
    return F.least(F.lit(int(samples)), n).cast("int")


def subsamples(rows: DataFrame, trees: int, samples: int | float, seed: int) -> DataFrame:
    """Training rows for each (joint, block of trees), chosen by a seeded hash of their own.

    A block draws from all rows of its joint whatever its size, about TREES_PER_TASK times the rows of a tree and
    some more, so that hardly ever fewer are left than a tree needs. ``samples`` bounds what a task holds.
    """
    wanted = sample_size(samples, F.col("n")) * TREES_PER_TASK
    enough = (wanted + 10 * F.sqrt(wanted) + 100) / F.col("n")
    blocks = F.sequence(F.lit(0), F.lit(-(-trees // TREES_PER_TASK) - 1))
    share = lambda block: F.shiftrightunsigned(F.xxhash64("joint_id", "seq", F.lit(seed), block), 11) / float(2**53)
    rows = rows.withColumn("size", sample_size(samples, F.col("n")))
    return rows.withColumn("block", F.explode(F.filter(blocks, lambda block: share(block) < enough)))


def fit_forest(rows: DataFrame, trees: int = 100, samples: int | float = AUTO_SAMPLES, seed: int = 42) -> DataFrame:
    """One row per joint: subsample size and the grown trees."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        joint, block = table["joint_id"][0].as_py(), table["block"][0].as_py()
        x, size = matrix(table["x"]), table["size"][0].as_py()
        out = []
        for number in range(block * TREES_PER_TASK, min((block + 1) * TREES_PER_TASK, trees)):
            rng = joint_seed(joint, seed, number)
            pick = rng.choice(len(x), min(size, len(x)), replace=False)
            out.append({"joint_id": joint, "number": number, "samples": len(pick), "tree": grow_tree(x[pick], rng)})
        return pa.Table.from_pylist(out, schema=arrow)

    node = pa.struct([("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())),
                      ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("path", pa.list_(pa.float64()))])
    arrow = pa.schema([("joint_id", pa.string()), ("number", pa.int32()), ("samples", pa.int32()), ("tree", node)])
    spark_node = ("struct<feature: array<int>, threshold: array<double>, left: array<int>, right: array<int>, "
                  "path: array<double>>")
    grown = subsamples(rows, trees, samples, seed).groupBy("joint_id", "block").applyInArrow(
        grow, f"joint_id string, number int, samples int, tree {spark_node}")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("number", "tree"))), lambda s: s["tree"])
    return grown.groupBy("joint_id").agg(F.max("samples").alias("samples"), ordered.alias("trees"))


def isolation_forest(rows: DataFrame, params: dict, seed: int = 42, wide: bool = False) -> DataFrame:
    """Labels and scores. Columns that travel along are written here only with ``wide``: else the scores are, for their
    quantile, and the rows are scored once more as the result is read."""
    samples = numeric_or(params.get("max_samples", "auto"), {"auto": AUTO_SAMPLES})
    models = materialise(fit_forest(rows, params.get("n_estimators", 100), samples, seed))
    scores, values = scores_and_values(rows, models, forest_score, wide)
    return label_below(scores, params.get("contamination", 0.05), shift=True, values=values)
