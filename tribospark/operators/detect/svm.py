"""One-class SVM per joint (Schölkopf et al., 2001) on explicit kernel features, solved to a duality gap.

The rbf kernel is mapped to random Fourier features (Rahimi and Recht, 2007), poly and sigmoid to Nyström
features on landmarks drawn from each joint (Williams and Seeger, 2001); the linear kernel needs none.
The primal problem is followed along its central path: the hinge is replaced by the smooth loss that a log barrier
leaves of it, and one pass over the rows sums, for each joint, loss, gradient and curvature for one Newton
step. The barrier is lowered after each full step. A dual point comes with every pass, so the distance to the
optimum is known, and a joint rests once it is small.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribospark.operators.detect.common import matrix, numeric_or, parts_of, scores_and_values, shared_models, summed
from tribospark.operators.quantiles import exact_quantiles
from tribospark.session import materialise, settled

KERNELS = ("rbf", "linear", "poly", "sigmoid")
FOURIER_FEATURES = 256
#: Landmarks of a joint, at most about, and eigenvalues kept, relative to the largest.
LANDMARKS, SPECTRUM = 256, 1e-8
#: Rows that are mapped at once: their mapped forms stay in a core's cache, and bound what a task holds.
PIECE = 1024
#: Degree and offset of the poly and sigmoid kernels.
DEGREE, OFFSET = 3, 0.0
#: A joint is done when its gap is this small next to the mean squared length of its mapped rows; passes at most.
GAP, PASSES = 1e-3, 100
#: The barrier after a full step; the share a step is cut to that does not lower the loss enough; and, where it has
#: been cut below the third, the barrier that is tried from the same point.
LOWERED, SHORTENED, SHORTEST, RAISED = 0.4, 0.4, 0.1, 2.0
STATE = ("w", "base", "step")
SCHEMA = "joint_id string, spread double, marks array<double>, w array<double>, base array<double>, step array<double>, numbers array<double>"
#: What ``numbers`` holds: length of the step, slope, loss at the base, barriers of that loss and of the next
#: derivatives, mean squared length, duality gap, passes, and whether the joint is done.
T, SLOPE, LOSS, TAU_BASE, TAU, SCALE, GAP_AT, PASS, DONE = range(9)


def kernel(a: np.ndarray, b: np.ndarray, name: str, gamma: float) -> np.ndarray:
    dot = gamma * (a @ b.T) + OFFSET
    # products take a tenth of the time of a power
    return reduce(np.multiply, [dot] * DEGREE) if name == "poly" else np.tanh(dot)


def feature_mapping(features: int, name: str, gamma: float, seed: int, marks: np.ndarray | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """The function from rows to explicit features whose dot product approximates the kernel.

    Nyström features keep the positive part of the landmarks' kernel matrix (sigmoid has a negative part).
    """
    if name == "linear":
        return lambda x: x
    if name == "rbf":
        rng = np.random.default_rng(seed)
        w = rng.normal(scale=np.sqrt(2 * gamma), size=(features, FOURIER_FEATURES))
        phase, size = rng.uniform(0, 2 * np.pi, FOURIER_FEATURES), np.sqrt(2.0 / FOURIER_FEATURES)

        def waves(x: np.ndarray) -> np.ndarray:
            angle = x @ w
            angle += phase
            np.cos(angle, out=angle)
            angle *= size
            return angle

        return waves
    values, vectors = np.linalg.eigh(kernel(marks, marks, name, gamma))
    kept = values > max(values[-1], 0.0) * SPECTRUM
    if not kept.any():
        return lambda x: np.zeros((len(x), 1))
    axes = vectors[:, kept] / np.sqrt(values[kept])
    return lambda x: kernel(x, marks, name, gamma) @ axes


def feature_map(x: np.ndarray, name: str, gamma: float, seed: int, marks: np.ndarray | None = None) -> np.ndarray:
    """Explicit features of the rows of ``x``, see ``feature_mapping``."""
    return feature_mapping(x.shape[1], name, gamma, seed, marks)(x)


def kernel_width(model: dict, features: int, gamma) -> float:
    """``scale`` is 1 / (features * variance of all scaled values), ``auto`` is 1 / features."""
    if gamma == "scale":
        return 1.0 / (features * model["spread"]) if model["spread"] > 0 else 1.0
    return 1.0 / features if gamma == "auto" else gamma


def barrier_terms(z: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smooth loss of being ``z`` outside, its slope (0 to 1) and curvature.

    The least s - tau log s - tau log(s - z) over slacks s, in forms that don't cancel.
    """
    r = np.sqrt(z * z + 4 * tau * tau)
    far, near = tau + (np.abs(z) + r) / 2, tau + 2 * tau * tau / (np.abs(z) + r)
    slack, room = np.where(z > 0, far, near), np.where(z > 0, near, far)
    bend = np.where(z > 0, 2 * tau * tau / (r * (r + np.abs(z))), (1 - z / r) / 2)
    return slack - tau * np.log(slack) - tau * np.log(room), tau / room, tau * bend / (room * room)


def _partial(model: dict, phi: np.ndarray) -> np.ndarray:
    """Rows, squared lengths, hinge, loss for the old and the new barrier, and the derivatives for the new one."""
    numbers = model["numbers"]
    if not numbers:
        return np.concatenate([[len(phi), (phi * phi).sum()], phi.sum(axis=0)])
    w = np.asarray(model["w"])
    z = w[-1] - phi @ w[:-1]
    loss, a, bend = barrier_terms(z, numbers[TAU])
    old = loss if numbers[TAU_BASE] == numbers[TAU] else barrier_terms(z, numbers[TAU_BASE])[0]
    wide = np.column_stack([phi, -np.ones(len(phi))])
    slopes = a @ wide
    wide *= np.sqrt(bend)[:, None]  # a matrix times its own transpose takes half the products
    return np.concatenate([[len(phi), np.maximum(z, 0).sum(), old.sum(), loss.sum()], slopes, (wide.T @ wide).ravel()])


def _start(total: np.ndarray) -> dict:
    """The mean mapped row as weights, its squared length (the mean margin) as offset, kept as the dual's fallback."""
    n, scale, mean = total[0], total[1] / total[0], total[2:] / total[0]
    square = mean @ mean
    tau = max(0.5 * np.sqrt(square * max(scale - square, 0.0)), 1e-9 * max(scale, 1e-300))
    w = np.append(mean, square)
    return {"w": w, "base": np.append(mean, np.nan), "step": np.zeros(0), "numbers": [1.0, 0.0, np.nan, tau, tau, scale, np.inf, 0.0, 0.0]}


def _advance(state: dict, total: np.ndarray, nu: float) -> dict:
    """One Newton step along the central path, or a shorter one if the last did not help."""
    numbers, w = list(state["numbers"]), np.asarray(state["w"])
    if numbers[DONE]:
        return {k: state[k] for k in (*STATE, "numbers")}
    d, n, hinge, old = len(w) - 1, total[0], total[1], total[2]
    numbers[PASS] += 1
    c = 1 / (nu * n)
    energy = 0.5 * w[:-1] @ w[:-1] - w[-1]
    started = len(state["step"]) > 0
    if started and energy + c * old > numbers[LOSS] + 1e-4 * numbers[T] * numbers[SLOPE] + 1e-12 * abs(numbers[LOSS]):
        numbers[T] *= SHORTENED
        numbers[TAU] = numbers[TAU_BASE]
        base, step = np.asarray(state["base"]), np.asarray(state["step"])
        if numbers[T] < SHORTEST:  # back to the base, with a smoother loss
            numbers[T], numbers[TAU], numbers[LOSS] = 0.0, numbers[TAU_BASE] * RAISED, np.inf
        return {"w": base[: d + 1] + numbers[T] * step, "base": base, "step": step, "numbers": _ended(numbers)}
    mean = np.asarray(state["base"])[-d:] if started else np.asarray(state["base"])[:d]
    pull, share = c * total[4 : 4 + d], -c * total[4 + d]
    if share >= 1:
        dual = pull / share
    else:  # topped up with equal weights on all rows, which keeps each below its bound
        part = (1 - nu) / (1 - nu * share)
        dual = part * pull + (1 - part * share) * mean
    numbers[GAP_AT] = energy + c * hinge + 0.5 * dual @ dual
    gradient = np.append(w[:-1] - pull, share - 1)
    curve = c * total[5 + d :].reshape(d + 1, d + 1)
    curve[np.arange(d), np.arange(d)] += 1
    curve[d, d] += 1e-12
    step = -np.linalg.solve(curve, gradient)
    numbers[SLOPE], numbers[LOSS] = gradient @ step, energy + c * total[3]
    # the loss and derivatives are those of TAU; the next pass tests the step with it, and lowers it if it is a whole one
    numbers[TAU_BASE], numbers[TAU], numbers[T] = numbers[TAU], numbers[TAU] * LOWERED, 1.0
    if numbers[GAP_AT] <= GAP * numbers[SCALE]:
        numbers[DONE] = 1.0
        return {"w": w, "base": np.concatenate([w, mean]), "step": step, "numbers": numbers}
    return {"w": w + step, "base": np.concatenate([w, mean]), "step": step, "numbers": _ended(numbers)}


def _ended(numbers: list[float]) -> list[float]:
    return numbers[:DONE] + [float(numbers[PASS] >= PASSES)]


def fit(rows: DataFrame, kernel_name: str, nu: float, gamma, seed: int, passes: int = PASSES, **sharing) -> DataFrame:
    """joint_id, spread, marks, w (weights and offset) and numbers (see ``T``) of each joint's boundary."""

    def partial(model: dict, x: np.ndarray) -> np.ndarray:
        if model["numbers"] and model["numbers"][DONE]:
            return np.zeros(1)
        mapping = _mapping(model, x.shape[1], kernel_name, gamma, seed)
        return sum(_partial(model, mapping(piece)) for piece in pieces(x))

    def move(left: pa.Table, right: pa.Table) -> pa.Table:
        state, total = left.to_pylist()[0], np.frombuffer(right["state"][0].as_py())
        new = _start(total) if not state["numbers"] else _advance(state, total, nu)
        arrays = {k: pa.array([list(map(float, new[k]))], pa.list_(pa.float64())) for k in (*STATE, "numbers")}
        return pa.table({"joint_id": left["joint_id"], "spread": left["spread"], "marks": left["marks"], **arrays})

    points = rows.select("joint_id", "seq", "x")
    values = points.select("joint_id", F.explode("x").alias("v"))
    empty = F.array().cast("array<double>")
    models = values.groupBy("joint_id").agg(F.var_pop("v").alias("spread"))
    models = models.join(_landmarks(points) if kernel_name in ("poly", "sigmoid") else models.select("joint_id", empty.alias("marks")), "joint_id")
    models = materialise(models.select("joint_id", "spread", "marks", *[empty.alias(c) for c in (*STATE, "numbers")]))
    known = shared_models(models, **sharing)
    widest = parts_of(points, known=known, **sharing)
    for _ in range(passes + 2):
        sums = summed(points, models, partial, widest, known=known, **sharing)
        models = materialise(models.groupBy("joint_id").cogroup(sums.groupBy("joint_id")).applyInArrow(move, SCHEMA))
        if known is not None:  # as many joints as before, and some arrays of the mapped width each
            known = {r["joint_id"]: r.asDict(recursive=True) for r in models.collect()}
            done = all(model["numbers"][DONE] for model in known.values())
        else:
            done = models.where(F.get("numbers", F.lit(DONE)) == 0).isEmpty()
        if done:
            break
    return models


def _landmarks(points: DataFrame) -> DataFrame:
    """joint_id, marks: about LANDMARKS rows of each joint, drawn by a hash, one after the other."""

    def join_up(table: pa.Table) -> pa.Table:
        marks = matrix(table.sort_by("seq")["x"]).ravel()
        return pa.table({"joint_id": table["joint_id"][:1], "marks": pa.array([marks], pa.list_(pa.float64()))})

    sizes = points.groupBy("joint_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    share = F.shiftrightunsigned(F.xxhash64("joint_id", "seq", F.lit("landmark")), 11) / float(2**53)
    drawn = points.join(sizes, "joint_id").where((share < LANDMARKS / F.col("n")) | (F.col("seq") == F.col("first")))
    return drawn.select("joint_id", "seq", "x").groupBy("joint_id").applyInArrow(join_up, "joint_id string, marks array<double>")


def _mapping(model: dict, features: int, kernel_name: str, gamma, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """The joint's mapping, made once for each task: the model keeps it."""
    if "mapping" not in model:
        marks = np.asarray(model["marks"]).reshape(-1, features) if model["marks"] else None
        model["mapping"] = feature_mapping(features, kernel_name, kernel_width(model, features, gamma), seed, marks)
    return model["mapping"]


def pieces(x: np.ndarray) -> list[np.ndarray]:
    return [x[i : i + PIECE] for i in range(0, len(x), PIECE)]


def one_class_svm(rows: DataFrame, params: dict, seed: int = 42, passes: int = PASSES, wide: bool = True, **sharing) -> DataFrame:
    """Labels and scores: the score is the margin above the offset, negative outside the boundary.

    Unless ``wide`` the scaled columns alone are written, while the boundary is learned, and the rows are scored twice.
    """
    name, nu, gamma = params.get("kernel", "rbf"), params.get("nu", 0.05), numeric_or(params.get("gamma", "scale"), {"scale": "scale", "auto": "auto"})
    if name not in KERNELS:
        raise ValueError(f"unsupported kernel {name!r}; use one of {', '.join(KERNELS)}")
    points = rows.select("joint_id", "seq", "x")
    models = settled(lambda: fit(points if wide else materialise(points), name, nu, gamma, seed, passes, **sharing).select("joint_id", "spread", "marks", "w"))

    def margin(model: dict, x: np.ndarray) -> np.ndarray:
        w, mapping = np.asarray(model["w"]), _mapping(model, x.shape[1], name, gamma, seed)
        return np.concatenate([mapping(piece) @ w[:-1] for piece in pieces(x)])

    margins, values = scores_and_values(rows, models, margin, wide, **sharing)
    # For fixed weights the best offset is the nu-quantile of the margins.
    cut = materialise(exact_quantiles(values, ["joint_id"], "value", [nu], "_cut"))
    score = F.col("value") - F.col("_cut")[0]
    out = margins.join(cut, "joint_id")
    return out.withColumns({"anomaly": F.when(score < 0, -1).otherwise(1), "anomaly_score": score}).drop("value", "_cut")
