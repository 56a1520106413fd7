"""Diagnostics of scored features, with and without ground truth."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tribospark.operators.detect.common import EPSILON, co_moments, matrix, standardise, usable
from tribospark.operators.detect.registry import MODELS, ModelConfig, check_config, default_config
from tribospark.operators.ordering import number_rows, running_totals
from tribospark.operators.quantiles import exact_quantiles
from tribospark.operators.selection import feature_columns
from tribospark.session import materialise, settled, side_by_side

EVERYTHING = "all_joints"
SILHOUETTE_ROWS = 5_000
#: Rows of a label that all others are compared with, and the parts left out in turn.
REFERENCES, LEFT_OUT = 1_024, 16
#: Rows of either side that distances are held of at once, and pairs for a task.
PIECE, REFERENCE_PIECE, PAIRS = 128, 4_096, 2**25
#: A squared distance below this share of the squared lengths is taken from the differences, of so many pairs at once.
NEAR, PAIRS_AT_ONCE = 1e-4, 2**16
#: Fits of the permutation importance that run side by side for a feature, and features: the jobs of one are short and leave cores idle.
FITS_AT_ONCE, FEATURES_AT_ONCE = 4, 2
HISTOGRAM_BINS = 30
SWEEP_POINTS = 50
ROC_POINTS = 200

# Label column names, and words that mean normal.
TRUTH_NAMES = (
    "label", "labels", "ground_truth", "true_label", "true_anomaly", "is_anomaly", "fault", "failure", "class", "target",
    "defect", "anomaly_label", "gt_anomaly",
)
NORMAL_WORDS = ("normal", "ok", "good", "healthy", "0", "no", "false")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def anomaly_totals(scored: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("anomaly") == -1)
    return scored.agg(
        F.count("*").alias("n_total"), bad.alias("n_anomalies"),
        (bad / F.greatest(F.count("*"), F.lit(1))).alias("global_anomaly_rate"))


def cluster_points(scored: DataFrame, columns: list[str]) -> DataFrame:
    """All rows with the features as one array ``x`` and the label."""
    return scored.select("joint_id", "seq", "anomaly", F.array(*[F.coalesce(usable(c), F.lit(0.0)) for c in columns]).alias("x"))


def label_groups(points: DataFrame) -> tuple[list[float], dict[int, tuple[int, list[float], float]]]:
    """Mean of all points, and for each label: rows, sum and sum of squared lengths of the points less that mean.

    Two aggregates with one small row for each label; the subtraction keeps far-off features from cancelling.
    """
    at = range(points.agg(F.max(F.size("x"))).first()[0] or 0)
    means = [float(m or 0.0) for m in points.agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in at])).first()[0]]
    away = _less(means)
    rows = points.select("anomaly", away.alias("x")).groupBy("anomaly").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(i))) for i in at]).alias("s"), F.sum(_dot(F.col("x"), F.col("x"))).alias("q")).collect()
    return means, {r["anomaly"]: (r["n"], [float(v) for v in r["s"]], float(r["q"])) for r in rows}


def _less(means: list[float]) -> Column:
    return F.zip_with("x", F.array(*[F.lit(m) for m in means]), lambda v, m: v - m)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, v: total + v)


def silhouette(points: DataFrame, known: tuple | None = None) -> DataFrame:
    """One row: mean silhouette of the label groups over all rows, with squared Euclidean distances; null with one group.

    The mean squared distance of a point to a group follows from the group's count, sum and sum of squares, so no pairs are formed. ``known`` is
    what ``label_groups`` gave, if the caller asked.
    """
    spark = points.sparkSession
    means, groups = known or label_groups(points)
    if len(groups) < 2:
        return spark.createDataFrame([(None,)], "silhouette_score double")
    rows = points.select("anomaly", _less(means).alias("x")).withColumn("own", _dot(F.col("x"), F.col("x")))

    def total(label: int) -> Column:
        n, s, q = groups[label]
        return F.greatest(n * F.col("own") - 2 * _dot(F.col("x"), F.array(*[F.lit(v) for v in s])) + q, F.lit(0.0))

    inside, beside = F.lit(None).cast("double"), F.lit(None).cast("double")
    for label, (n, _, _) in groups.items():
        mine = F.col("anomaly") == label
        inside = F.when(mine, total(label) / (n - 1) if n > 1 else F.lit(None).cast("double")).otherwise(inside)
        beside = F.when(mine, beside).otherwise(F.least(beside, total(label) / n))
    both = rows.select(inside.alias("a"), beside.alias("b"))
    top = F.greatest("a", "b")
    score = F.when(F.col("a").isNotNull() & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return both.agg(F.round(F.avg(score), 4).alias("silhouette_score"))


def euclidean_silhouette(sample: DataFrame, max_rows: int = SILHOUETTE_ROWS) -> DataFrame:
    """One row: mean silhouette with plain distances. All pairs are formed, so it is for a sample that the caller has drawn."""
    sample = materialise(sample.select("anomaly", "x"))
    n = sample.count()
    if n > max_rows:
        raise ValueError(f"more than {max_rows} rows; draw a sample or use silhouette()")
    if sample.select("anomaly").distinct().count() < 2:
        return sample.sparkSession.createDataFrame([(None,)], "silhouette_score double")
    whole = sample.toArrow()
    labels, points = whole["anomaly"].to_numpy(), matrix(whole["x"])
    names, sizes = np.unique(labels, return_counts=True)
    points, ends = points[np.argsort(labels, kind="stable")], np.concatenate([[0], np.cumsum(sizes)])

    def run(batches):
        for batch in batches:
            x, own = matrix(pa.chunked_array([batch.column("x")])), batch.column("anomaly").to_numpy()
            sums = np.zeros((len(x), len(names)))
            for k, (first, end) in enumerate(zip(ends, ends[1:])):
                for start, at in product(range(0, len(x), PIECE), range(first, end, REFERENCE_PIECE)):
                    sums[start : start + PIECE, k] += plain_distances(x[start : start + PIECE], points[at : min(at + REFERENCE_PIECE, end)]).sum(axis=1)
            mine = own[:, None] == names[None, :]
            n_own = sizes[mine.argmax(axis=1)]
            a = sums[mine] / np.maximum(n_own - 1, 1)
            b = np.where(mine, np.inf, sums / sizes).min(axis=1)
            top = np.maximum(a, b)
            out = np.where((n_own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
            yield pa.record_batch({"s": pa.array(out)})

    return dealt(sample, n, n).mapInArrow(run, "s double").agg(F.round(F.avg("s"), 4).alias("silhouette_score"))


def plain_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs by one matrix product; those so near that it would cancel are taken from the differences."""
    centre = b.mean(axis=0)
    x, y = a - centre, b - centre
    lengths = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
    squares = lengths - 2 * (x @ y.T)
    lengths *= NEAR
    row, at = np.nonzero(~(squares >= lengths))  # also where a value is not finite
    for start in range(0, len(row), PAIRS_AT_ONCE):
        i, j = row[start : start + PAIRS_AT_ONCE], at[start : start + PAIRS_AT_ONCE]
        squares[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(squares, out=squares)


def dealt(rows: DataFrame, n: int, compared: int) -> DataFrame:
    """The rows in as many tasks as comparing each with ``compared`` others takes, PAIRS for a task."""
    return rows.repartition(min(-(-n * compared // PAIRS), 1024)) if n * compared > PAIRS else rows


def reference_silhouette(points: DataFrame, references: int = REFERENCES, seed: int = 42) -> DataFrame:
    """One row: mean silhouette of all rows with plain distances, and the bounds between which it lies.

    ``points``: joint_id, seq (together unique), anomaly, x. Each row is compared with the rows of a label, or with about
    ``references`` of them drawn by a hash where it has more, which are sent to the tasks; so the work is linear in the
    rows. The bounds are three standard errors away, from leaving out each sixteenth of the references in turn
    (jackknife). With all rows compared the score is exact and the bounds meet. Null with one label only.
    """
    spark = points.sparkSession
    place = F.xxhash64("joint_id", "seq", F.lit(seed))
    sizes = points.groupBy("anomaly").agg(F.count("*").alias("n"))
    known = {r["anomaly"]: r["n"] for r in sizes.collect()}
    schema = "silhouette_score double, low double, high double"
    if len(known) < 2:
        return spark.createDataFrame([(None, None, None)], schema)
    labels = sorted(known)
    share = F.shiftrightunsigned(place, 11) / float(2**53)
    wanted = F.create_map(*[F.lit(v) for k in labels for v in (k, 1.0 if known[k] <= references else references / known[k])])[F.col("anomaly")]
    drawn = points.where(share < wanted).select("joint_id", "seq", "anomaly", "x", F.pmod(place, F.lit(LEFT_OUT)).alias("g")).toArrow()
    if len(set(drawn["anomaly"].to_pylist())) < len(labels):
        raise ValueError("a label has no reference; ask for more")
    centre = matrix(drawn["x"]).mean(axis=0)
    x_of, k_of, g_of = matrix(drawn["x"]) - centre, np.searchsorted(labels, drawn["anomaly"].to_numpy()), drawn["g"].to_numpy()
    cell = k_of * LEFT_OUT + g_of  # references by label and part
    order = np.argsort(cell, kind="stable")
    x_of, cell = x_of[order], cell[order]
    square, held = (x_of * x_of).sum(axis=1), np.bincount(cell, minlength=len(labels) * LEFT_OUT)
    itself = {key: i for i, key in enumerate(zip(drawn["joint_id"].take(pa.array(order)).to_pylist(), drawn["seq"].take(pa.array(order)).to_pylist()))}
    alone = np.array([known[k] == 1 for k in labels])

    def score(sums, counts, own, rows):
        """Silhouettes from sums of distances and numbers of references, both by row and label."""
        mean = sums / np.maximum(counts, 1)
        a = mean[rows, own]
        mean[rows, own] = np.inf
        b = mean.min(axis=1)
        top = np.maximum(a, b)
        return np.where(alone[own] | (top <= 0), 0.0, (b - a) / np.where(top > 0, top, 1))

    def run(batches):
        for batch in batches:
            keys = list(zip(batch.column("joint_id").to_pylist(), batch.column("seq").to_pylist()))
            every, label = matrix(pa.chunked_array([batch.column("x")])) - centre, np.searchsorted(labels, batch.column("anomaly").to_numpy())
            total = np.zeros(LEFT_OUT + 1)
            for start in range(0, len(every), 512):
                x, own = every[start : start + 512], label[start : start + 512]
                rows = np.arange(len(x))
                counts, sums = np.tile(held, (len(x), 1)), np.zeros((len(x), len(held)))
                me = np.array([itself.get(key, -1) for key in keys[start : start + 512]])
                counts[rows[me >= 0], cell[me[me >= 0]]] -= 1
                for at in range(0, len(x_of), REFERENCE_PIECE):
                    piece = slice(at, at + REFERENCE_PIECE)
                    apart = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + square[piece] - 2 * x @ x_of[piece].T, 0))
                    here = (me >= at) & (me < at + REFERENCE_PIECE)
                    apart[rows[here], me[here] - at] = 0.0
                    sums += np.stack([np.bincount(cell[piece], row, len(held)) for row in apart])
                sums = sums.reshape(len(x), len(labels), LEFT_OUT)
                counts = counts.reshape(len(x), len(labels), LEFT_OUT)
                whole, n = sums.sum(axis=2), counts.sum(axis=2)
                total[0] += score(whole.copy(), n, own, rows).sum()
                for g in range(LEFT_OUT):
                    total[1 + g] += score(whole - sums[:, :, g], n - counts[:, :, g], own, rows).sum()
            yield pa.record_batch({"i": pa.array(np.arange(LEFT_OUT + 1), pa.int32()), "s": pa.array(total)})

    n = sum(known.values())
    exact = all(size <= references for size in known.values())
    asked = points.select("joint_id", "seq", "anomaly", "x")
    found = (dealt(asked, n, len(x_of)) if exact else asked).mapInArrow(run, "i int, s double").groupBy("i").agg((F.sum("s") / n).alias("s"))
    parts = F.when(F.col("i") > 0, F.col("s"))
    spread = F.lit(0.0) if exact else 3 * F.sqrt(F.var_pop(parts) * (LEFT_OUT - 1))
    out = found.agg(F.max(F.when(F.col("i") == 0, F.col("s"))).alias("s"), spread.alias("e"))
    return out.select(F.round("s", 4).alias("silhouette_score"), (F.col("s") - F.col("e")).alias("low"), (F.col("s") + F.col("e")).alias("high"))


def calinski_harabasz(points: DataFrame, known: tuple | None = None) -> DataFrame:
    """One row: between-group over within-group dispersion of the label groups over all rows; null with one group."""
    _, groups = known or label_groups(points)
    k, n = len(groups), sum(g[0] for g in groups.values())
    score = None
    if k >= 2:
        between = sum(sum(v * v for v in s) / m for m, s, _ in groups.values())
        within = sum(q for _, _, q in groups.values()) - between
        if within <= 0:
            score = 1.0
        elif n > k:
            score = round(between * (n - k) / (within * (k - 1)), 4)
    return points.sparkSession.createDataFrame([(score,)], "calinski_harabasz_score double")


def _with_total(scored: DataFrame) -> DataFrame:
    """Each row once for its joint and once for the whole table."""
    return scored.withColumn("joint_id", F.explode(F.array("joint_id", F.lit(EVERYTHING))))


def score_distribution(scored: DataFrame) -> DataFrame:
    """Moments and quartiles of the finite scores, per joint and overall."""
    rows = _with_total(scored.select("joint_id", "anomaly", "anomaly_score"))
    score = F.when(is_finite(F.col("anomaly_score")), F.col("anomaly_score"))
    rows = rows.withColumn("anomaly_score", score)
    bad = F.count_if(F.col("anomaly") == -1)
    stats = rows.groupBy("joint_id").agg(
        F.avg("anomaly_score").alias("mean"), F.stddev_pop("anomaly_score").alias("std"), F.min("anomaly_score").alias("min"),
        F.max("anomaly_score").alias("max"), F.count("*").alias("n_total"), bad.alias("n_anomalies"),
        (bad / F.count("*")).alias("anomaly_rate"))
    quartiles = exact_quantiles(rows, ["joint_id"], "anomaly_score", [0.25, 0.5, 0.75], "_q")
    out = stats.join(quartiles, "joint_id", "left").select(
        "joint_id", "mean", "std", "min", "max", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q25"),
        F.col("_q")[2].alias("q75"), "n_total", "n_anomalies", "anomaly_rate")
    return out.fillna(0.0, ["mean", "std", "min", "max", "median", "q25", "q75"])


def score_histogram(scored: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram per joint and overall, with empty bins; the last bin is closed."""
    rows = _with_total(scored.select("joint_id", "anomaly_score")).filter(is_finite(F.col("anomaly_score")))
    spans = rows.groupBy("joint_id").agg(F.min("anomaly_score").alias("lo"), F.max("anomaly_score").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    spans = materialise(spans.select(
        "joint_id", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    v = F.col("anomaly_score")
    guess = F.least(F.floor((v - F.col("lo")) / width), F.lit(bins - 1))
    # Rounding in the division may miss an edge by one bin; the edges themselves decide.
    bin_ = (
        F.when(v < F.col("lo") + guess * width, guess - 1)
        .when((v >= F.col("lo") + (guess + 1) * width) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    counts = rows.join(spans, "joint_id").groupBy("joint_id", bin_.alias("bin")).agg(F.count("*").alias("count"))
    frame = spans.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    edges = frame.select(
        "joint_id", "bin", F.round(F.col("lo") + F.col("bin") * width, 6).alias("left_edge"),
        F.round(F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width), 6).alias("right_edge"))
    return edges.join(counts, ["joint_id", "bin"], "left").fillna(0, ["count"])


def threshold_sweep(scored: DataFrame, points: int = SWEEP_POINTS, direction: str = "above") -> DataFrame:
    """How many scores lie beyond each of ``points`` evenly spaced percentiles.

    Scores are lower for worse rows, so ``above`` (the default) counts the better side;
    ``below`` counts the rows a threshold would flag.
    """
    if direction not in ("above", "below"):
        raise ValueError("direction must be above or below")
    rows = scored.filter(is_finite(F.col("anomaly_score"))).select("anomaly_score")
    probs = [float(p) for p in np.linspace(0, 100, points) / 100]
    cuts = exact_quantiles(rows, [], "anomaly_score", probs, "t").select("t").scalar()
    rows = rows.withColumn("_t", cuts)

    def beyond(i):
        cut = F.element_at("_t", i + 1)
        return F.col("anomaly_score") > cut if direction == "above" else F.col("anomaly_score") < cut

    counted = rows.agg(
        F.count("*").alias("n"),
        F.array(*[F.struct(F.max(F.element_at("_t", i + 1)).alias("t"), F.count_if(beyond(i)).alias("c")) for i in range(points)]).alias("p"))
    return counted.select("n", F.posexplode("p").alias("point", "p")).filter("n > 0").select(
        "point", F.round("p.t", 6).alias("threshold"), F.col("p.c").alias("n_anomalies"),
        F.round(F.col("p.c") / F.col("n"), 4).alias("anomaly_rate"))


def current_threshold(scored: DataFrame) -> DataFrame:
    """Largest finite score among normal rows (the median of all if there is none), and the anomalies."""
    rows = scored.withColumn("anomaly_score", F.when(is_finite(F.col("anomaly_score")), F.col("anomaly_score")))
    middle = exact_quantiles(rows, [], "anomaly_score", [0.5], "m").select(F.col("m")[0]).scalar()
    top = rows.agg(
        F.max(F.when(F.col("anomaly") == 1, F.col("anomaly_score"))).alias("top"),
        F.count_if(F.col("anomaly") == -1).alias("current_n_anomalies"))
    return top.withColumn("_m", middle).select(F.round(F.coalesce("top", "_m"), 6).alias("current_threshold"), "current_n_anomalies")


def truth_column(df: DataFrame) -> str | None:
    """First column with an accepted label name and two to five distinct values."""
    named = [c for c in df.columns if c.lower().strip() in TRUTH_NAMES]
    if not named:
        return None
    found = df.agg(*[F.count_distinct(c).alias(c) for c in named]).first()
    return next((c for c in named if 2 <= found[c] <= 5), None)


def with_truth(df: DataFrame, column: str, name: str = "truth") -> DataFrame:
    """Label as 0 (normal) or 1: -1 of a plus/minus-one label, any non-zero number, any text that
    is not a word for normal."""
    kind = df.schema[column].dataType
    if isinstance(kind, (NumericType, BooleanType)):
        value = F.col(column).cast("double")
        others = df.agg(F.count_if(~value.isin(1.0, -1.0)) == 0).scalar()
        df = df.withColumn("_signed", others)
        truth = F.when(F.col("_signed"), value == -1).otherwise(value != 0)
        return df.withColumn(name, F.coalesce(truth, F.lit(True)).cast("int")).drop("_signed")
    word = F.lower(F.trim(F.col(column).cast("string")))
    return df.withColumn(name, F.when(word.isin(*NORMAL_WORDS), 0).otherwise(1))


def confusion(df: DataFrame, truth: str = "truth") -> DataFrame:
    """Confusion counts and ratios, per joint and overall, in one pass."""
    t, p = F.col(truth) == 1, F.col("anomaly") == -1
    counts = df.select("joint_id", t.alias("t"), p.alias("p")).rollup("joint_id").agg(
        F.grouping("joint_id").alias("_all"), *[F.count_if(F.expr(test)).alias(name) for name, test in (
            ("tp", "t and p"), ("fp", "not t and p"), ("tn", "not t and not p"), ("fn", "t and not p"))])

    def at_least(c, floor):
        return F.greatest(c, F.lit(floor))

    precision = F.col("tp") / at_least(F.col("tp") + F.col("fp"), 1)
    recall = F.col("tp") / at_least(F.col("tp") + F.col("fn"), 1)
    f1 = 2 * precision * recall / at_least(precision + recall, 1e-9)
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return counts.select(
        F.when(F.col("_all") == 1, EVERYTHING).otherwise(F.col("joint_id")).alias("joint_id"), "tp", "fp", "tn", "fn",
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1_score"),
        F.round((F.col("tp") + F.col("tn")) / at_least(total, 1), 4).alias("accuracy"),
        (F.col("tn") + F.col("fp")).alias("support_normal"), (F.col("tp") + F.col("fn")).alias("support_anomaly"))


def roc_steps(df: DataFrame, truth: str = "truth", **windowing) -> DataFrame:
    """One row per distinct score from worst to best: cumulative positives and negatives."""
    ties = df.groupBy("anomaly_score").agg(F.sum(truth).alias("_p"), F.sum(1 - F.col(truth)).alias("_n"))
    return running_totals(ties, "anomaly_score", {"tp": "_p", "fp": "_n"}, **windowing)


def roc_auc(steps: DataFrame) -> DataFrame:
    """Area under the curve. Each tie group adds a trapezoid, which needs only its own totals."""
    ends = steps.agg(F.struct(F.max("tp").alias("p"), F.max("fp").alias("n"))).scalar()
    rows = steps.withColumn("_e", ends)
    area = F.sum(F.col("_n") * (2 * F.col("tp") - F.col("_p")) / 2.0)
    return rows.agg(F.round(F.try_divide(area, F.max("_e.p") * F.max("_e.n")), 4).alias("auc"))


def roc_points(steps: DataFrame, **windowing) -> DataFrame:
    """All corner points of the curve."""
    ends = materialise(steps.agg(F.max("tp").alias("p"), F.max("fp").alias("n")))
    numbered = number_rows(steps, [], ["anomaly_score"], "_i", **windowing)
    last = numbered.agg(F.max("_i")).scalar()
    # A point is on a straight run if the next tie group moves exactly as this one did.
    following = numbered.select((F.col("_i") - 1).alias("_i"), F.col("_p").alias("_p2"), F.col("_n").alias("_n2"))
    flagged = numbered.join(following, "_i", "left").withColumn("_last", last)
    corner = (F.col("_i") == 0) | (F.col("_i") == F.col("_last")) | (F.col("_p2") != F.col("_p")) | (F.col("_n2") != F.col("_n"))
    kept = flagged.filter(corner).select(F.col("anomaly_score"), "tp", "fp")
    origin = steps.sparkSession.createDataFrame([(float("-inf"), 0, 0)], "anomaly_score double, tp long, fp long")
    ordered = materialise(number_rows(kept.unionByName(origin), [], ["anomaly_score"], "point", **windowing))
    totals = ends.select(F.struct("*")).scalar()
    return ordered.withColumn("_e", totals).select(
        "point", F.round(F.try_divide(F.col("fp"), F.col("_e.n")), 4).alias("fpr"),
        F.round(F.try_divide(F.col("tp"), F.col("_e.p")), 4).alias("tpr"), F.round(-F.col("anomaly_score"), 6).alias("threshold"))


def thinned_points(points: DataFrame, most: int = ROC_POINTS) -> DataFrame:
    """At most ``most`` evenly spaced points of a curve, both ends included, for a chart."""
    points = materialise(points)
    n = points.count()
    if n <= most:
        return points
    return points.filter(F.col("point").isin(*sorted({k * (n - 1) // (most - 1) for k in range(most)})))


def _ranked(raw: DataFrame, top_n: int | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per feature: rank by raw importance, scaled by the best. Feature lists are schema-sized."""
    best = F.max("raw").over(Window.partitionBy())
    scale = F.when(best > 0, best).otherwise(1.0)
    rank = F.row_number().over(Window.orderBy(F.desc("raw"), "place"))
    out = raw.withColumns({"rank": rank, "importance": F.round(F.col("raw") / scale, 4), **{c: F.round(F.col(c) / scale, 4) for c in extra}})
    out = out.filter(F.col("rank") <= top_n) if top_n else out
    return out.select("feature", "importance", *extra, "rank")


def correlation_importance(scored: DataFrame, columns: list[str] | None = None, top_n: int | None = None,
                           exclude: tuple[str, ...] = ()) -> DataFrame:
    """Features by absolute correlation with the score, from one scan.

    A column that varies no more than the rounding error of its mean counts as constant.
    """
    columns = columns or feature_columns(scored, exclude)
    varies = lambda spread, mean: F.col(spread) > F.col("c") * F.pow(F.col(mean) * EPSILON, F.lit(2.0)) * F.col("c")
    found = co_moments(scored, columns, "anomaly_score")
    found = found.withColumn("r", F.when(varies("s", "m") & varies("so", "mo"), F.abs(F.col("x") / F.sqrt(F.col("s")) / F.sqrt(F.col("so")))))
    defined = (F.col("c") >= 10) & F.col("r").isNotNull() & ~F.isnan("r")
    names = scored.sparkSession.createDataFrame(list(enumerate(columns)), "place int, feature string")
    raw = names.join(found, F.col("place") == F.col("i"), "left").select(
        "place", "feature", F.when(defined, F.col("r")).otherwise(0.0).alias("raw"))
    return _ranked(raw, top_n)


def shuffled(rows: DataFrame, column: int, seed: int) -> DataFrame:
    """``rows`` (joint_id, seq, n, x) with entry ``column`` of ``x`` exactly permuted by a seeded hash."""
    order = rows.withColumn("_h", F.xxhash64("seq", F.lit(seed), F.lit(column)))
    giving = number_rows(order.select("seq", "_h", F.element_at("x", column + 1).alias("_v")), [], ["_h", "seq"], "_place").select("_place", "_v")
    taking = rows.withColumn("_place", F.col("seq"))  # seq is the running number of the pooled rows
    place = F.lit(column)
    return taking.join(giving, "_place").select("joint_id", "seq", "n", F.transform("x", lambda v, i: F.when(i == place, F.col("_v")).otherwise(v)).alias("x"))


def shuffled_values(rows: DataFrame, column: int, seeds: list[int]) -> DataFrame:
    """``rows`` (joint_id, seq, n, x) with ``_v``: for each seed the value that ``shuffled`` gives entry ``column`` of the row's ``x``.

    All seeds are numbered in one go, each a group of its own, and narrow rows meet the matrix once.
    """
    each = rows.select("seq", F.element_at("x", column + 1).alias("_v"), F.posexplode(F.array(*[F.lit(seed) for seed in seeds])).alias("_i", "_seed"))
    order = each.select("_i", "seq", F.xxhash64("seq", "_seed", F.lit(column)).alias("_h"), "_v")
    numbered = number_rows(order, ["_i"], ["_h", "seq"], "_place", without=("_h", "seq"))
    # every place has one value for each seed
    given = numbered.groupBy("_place").agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_{i}") for i in range(len(seeds))])
    given = given.select(F.col("_place").alias("seq"), F.array(*[f"_{i}" for i in range(len(seeds))]).alias("_v"))
    return rows.join(given, "seq").select("joint_id", "seq", "n", "x", "_v")


def permutation_importance(
    features: DataFrame,
    config: ModelConfig | None = None,
    columns: list[str] | None = None,
    repeats: int = 5,
    top_n: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Change of the mean score when one feature is shuffled and the detector is fitted again.

    All joints are pooled into one scaled matrix. One fit per feature and repeat: use it on few features. The matrix is
    written once more for a feature, with the values of all its repeats, while the fits of that feature run.
    """
    config = config or default_config()
    problem = check_config(config)
    if problem:
        raise ValueError(problem)
    columns = columns or feature_columns(features)

    def mean_score(rows: DataFrame) -> DataFrame:
        return MODELS[config.model_id].run(rows, config.params, config.seed).agg(F.avg("anomaly_score").alias("score"))

    def moves() -> DataFrame:
        pooled = standardise(features, columns, by=[])
        # One pooled group needs one running number in place of the per-joint ones.
        pooled = settled(lambda: number_rows(pooled, [], ["joint_id", "seq"], "_row").select(
            F.lit("pooled").alias("joint_id"), F.col("_row").alias("seq"), "n", "x"))

        def fitted(rows: DataFrame) -> float:
            return settled(lambda: mean_score(rows)).first()[0]

        base = fitted(pooled)

        def repeat(rows: DataFrame, column: int, i: int) -> DataFrame:
            place = F.lit(column)
            return rows.select("joint_id", "seq", "n", F.transform("x", lambda v, at: F.when(at == place, F.col("_v")[i]).otherwise(v)).alias("x"))

        def all_repeats(column: int) -> DataFrame:
            rows = settled(lambda: shuffled_values(pooled, column, [seed + i for i in range(repeats)]))
            fits = side_by_side(lambda i: fitted(repeat(rows, column, i)), range(repeats), FITS_AT_ONCE)
            return rows.sparkSession.createDataFrame([(column, [None if v is None else float(v) for v in fits])], "place int, scores array<double>")

        found = side_by_side(lambda column: settled(lambda: all_repeats(column)).first()["scores"], range(len(columns)), FEATURES_AT_ONCE)
        move = np.abs(base - np.array(found, dtype=float)).reshape(len(columns), repeats)
        raw = [(place, name, float(np.mean(move[place])), float(np.std(move[place]))) for place, name in enumerate(columns)]
        return features.sparkSession.createDataFrame(raw, "place int, feature string, raw double, std double")

    return _ranked(settled(moves), top_n, ("std",))


def diagnostics(
    scored: DataFrame,
    config: ModelConfig | None = None,
    truth: str | None = None,
    importance: bool = True,
) -> dict[str, DataFrame]:
    """Every report table by name. ``scored`` is read several times: hand over a written table."""
    truth = truth or truth_column(scored)
    columns = feature_columns(scored, (truth,) if truth else ())
    config = config or default_config()
    points = cluster_points(scored, columns)
    groups = label_groups(points)
    spark = scored.sparkSession
    model = spark.createDataFrame([(config.model_id, MODELS[config.model_id].title, len(columns), columns)],
                                  "model_id string, display_name string, n_features_used int, feature_names array<string>")
    out = {
        "model": model,
        "totals": anomaly_totals(scored).withColumns({
            "silhouette_score": silhouette(points, groups).scalar(), "calinski_harabasz_score": calinski_harabasz(points, groups).scalar()}),
        "distributions": score_distribution(scored),
        "histograms": score_histogram(scored),
        "thresholds": threshold_sweep(scored),
        "current_threshold": current_threshold(scored),
    }
    if truth:
        labelled = with_truth(scored, truth)
        steps = materialise(roc_steps(labelled))
        out.update(confusion=confusion(labelled), roc=roc_points(steps), auc=roc_auc(steps))
    if importance and columns:
        out["importance"] = correlation_importance(scored, columns)
    return out


def comparison_row(report: dict[str, DataFrame]) -> DataFrame:
    return report["model"].select("model_id", "display_name").withColumns({
        "silhouette_score": report["totals"].select("silhouette_score").scalar(),
        "anomaly_rate": report["totals"].select("global_anomaly_rate").scalar()})


def best_model(comparison: DataFrame) -> DataFrame:
    """The model with the highest silhouette; a missing one counts as -2, ties go to the first name."""
    return comparison.orderBy(F.desc(F.coalesce("silhouette_score", F.lit(-2.0))), "model_id").limit(1).select("model_id", "silhouette_score")
