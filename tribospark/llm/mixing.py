"""Mixing sources to target weights: subset-sum budget fitting over counts of documents by length.

A source whose target is T and whose size is S is taken floor(T / S) times as a whole. The rest of
the budget is fitted by lengths: of each length the same share of its documents is taken, rounded down,
then one more of as many lengths as fit, longest first, then more of them while much is left, and what is left is
solved exactly by bounded-knapsack dynamic programming. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribospark.llm.text import WORD
from tribospark.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
#: No source, and no document, is taken more often than this.
MOST = 2
#: The dynamic programme solves what is left below this many words.
SOLVED = 8192
#: Documents of one source and length that one task may rank.
RANKED = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length make the largest sum that is no more than ``budget`` (lengths > 0).

    ``spent[b]`` is how many of the current length the sum b needs at least; a sum stays reachable if
    it was so before, or if b - length is and has spent fewer than the length has documents. Only the length by which
    a sum was first reached is kept, and how many it took: what remains was reached by the lengths before it.
    """
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by, used = np.full(budget + 1, -1, np.int32), np.zeros(budget + 1, np.int64)
    for k, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        padded = -(-(budget + 1) // length) * length
        spent = np.full(padded, -1, np.int64)
        spent[: budget + 1][reached] = 0
        grid = spent.reshape(-1, length)  # a column holds the sums that differ by multiples of the length
        step = np.arange(len(grid))[:, None]
        last = np.maximum.accumulate(np.where(grid == 0, step, -1), axis=0)
        need = np.where((last >= 0) & (step - last <= count), step - last, -1).reshape(-1)[: budget + 1]
        new = (need > 0) & ~reached
        by[new], used[new] = k, need[new]
        reached |= new
        if reached[budget]:
            break
    left = int(np.flatnonzero(reached)[-1])
    taken = np.zeros(len(lengths), np.int64)
    while left:
        k, n = by[left], int(used[left])
        taken[k] = n
        left -= n * int(lengths[k])
    return taken


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come near ``budget``."""
    order = np.argsort(-lengths, kind="stable")
    length, count = lengths[order].astype(object), counts[order].astype(object)  # exact integers of any size
    total = int((length * count).sum())
    if not total:
        return np.zeros(len(lengths), np.int64)
    taken = np.array([int(c) * budget // total for c in count], object)
    left = budget - int((length * taken).sum())
    for most in (1, int(count.max())):  # one more of each length, then as many as there are
        for k in range(len(length)):
            if left <= SOLVED:
                break
            if length[k] and taken[k] < count[k] and length[k] <= left - SOLVED // 2:
                more = min(int(count[k] - taken[k]), (left - SOLVED // 2) // int(length[k]), most)
                taken[k] += more
                left -= more * int(length[k])
    if left > SOLVED:  # what is open is longer than left - SOLVED / 2, so one document fits at most
        longest = next((k for k in range(len(length)) if length[k] <= left and taken[k] < count[k] and length[k]), None)
        if longest is not None:
            taken[longest] += 1
            left -= int(length[longest])
    open_ = [k for k in range(len(length)) if 0 < length[k] <= left and taken[k] < count[k]]
    if open_ and left > 0:
        spare = np.array([min(int(count[k] - taken[k]), left) for k in open_])
        extra = bounded_knapsack(np.array([int(length[k]) for k in open_]), spare, left)  # no more than SOLVED
        for k, n in zip(open_, extra.tolist()):
            taken[k] += n
    out = np.zeros(len(lengths), np.int64)
    out[order] = taken.astype(np.int64)
    return out


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row for each source.

    Weights repeat over the sources by code point, null last. Targets are min(MOST * size, x * weight)
    for the x that spends the budget, which is what resharing the excess by weight ends at. In order of
    MOST * size / weight, sources are at their limit as long as x, fitted to the others, is above it.
    The window sees one row for each source.
    """
    place = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights)))
    table = sizes.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[place])
    limit = F.col("source_size") * float(MOST)
    order = Window.orderBy(limit / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    budget = F.sum("source_size").over(everything) * float(share)
    capped = F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (budget - capped) / open_weight
    table = table.select("source", "source_size", "weight", limit.alias("limit"), level.alias("level"))
    # the first source that is under its limit fixes the level of all after it
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)
    table = table.withColumn("x", first["level"])
    target = F.when(F.col("x").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("x") * F.col("weight")))
    return table.select("source", "source_size", target.alias("target"))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = 23) -> DataFrame:
    """(doc_id, source, size, source_size, target, times): one row for each document.

    ``times`` (0 to MOST) is how often the mix takes the document. A null text has size 0, a null source is
    a source of its own. Documents of size 0 are taken with their source as a whole only. Rows with the same doc_id,
    source and size are told apart in no way that matters. Other columns are ignored.
    """
    sized = materialise(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    counts = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = materialise(targets(sizes, weights, share))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        whole = min(int(target // size), MOST) if size else 0
        budget = 0 if whole == MOST else int(round(target - whole * size))
        lengths, n = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        picked = fit_lengths(lengths, n, min(budget, size))
        return pd.DataFrame({"source": frame["source"], "size": lengths, "n": n, "whole": whole, "picked": picked, "source_size": size, "target": target})

    kind = "source string, size bigint, n bigint, whole int, picked bigint, source_size bigint, target double"
    same = counts["source"].eqNullSafe(aims["source"])
    fitted = counts.join(aims, same).select(counts["source"], "size", "n", "source_size", "target")
    plan = materialise(fitted.groupBy("source").applyInPandas(fit, kind))  # a source has as many rows as lengths

    def with_plan(left: DataFrame, columns: list[str]) -> DataFrame:
        both = left["source"].eqNullSafe(plan["source"]) & (left["size"] == plan["size"])
        return left.join(plan, both).select(*[left[c] for c in left.columns], *columns)

    # Documents of one source and length are dealt into buckets in hash order; whole buckets are taken up to
    # the one in which the number wanted is reached, and only there are documents ranked.
    hashed = F.xxhash64("doc_id", F.lit(seed))
    bucket = F.pmod(F.shiftrightunsigned(hashed, 1), F.ceil(F.col("n") / RANKED)).cast("bigint")
    dealt = with_plan(sized, ["n", "whole", "picked", "source_size", "target"]).withColumn("hashed", hashed).withColumn("bucket", bucket)
    filled = dealt.groupBy("source", "size", "bucket").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("earlier", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    ranked = dealt.withColumn(
        "rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("hashed", "doc_id"))
    )
    f = filled.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), F.col("bucket").alias("f_bucket"), "earlier")
    at = ranked["source"].eqNullSafe(f["f_source"]) & (ranked["size"] == f["f_size"]) & (ranked["bucket"] == f["f_bucket"])
    times = F.col("whole") + (F.col("rank") + F.col("earlier") <= F.col("picked")).cast("int")
    return ranked.join(f, at).select("doc_id", "source", "size", "source_size", "target", times.alias("times"))


def mixed_documents(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = 23) -> DataFrame:
    """The documents that the mix takes, each as many times as it takes them, all columns as they were.

    Rows of one doc_id are taken alike, as often as the most taken of them.
    """
    times = mix(documents, weights, share, seed).groupBy("doc_id").agg(F.max("times").alias("times")).where("times > 0")
    times = times.select(F.col("doc_id").alias("__id"), "times")
    taken = documents.join(times, documents["doc_id"].eqNullSafe(times["__id"]))
    copies = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("__copy")
    return taken.select(*[documents[c] for c in documents.columns], copies).drop("__copy")
