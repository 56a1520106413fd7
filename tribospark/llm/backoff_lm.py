"""Stupid-backoff language-model scores (Brants et al., 2007) from counts of the whole corpus.

Documents are dealt into batches. A batch lists its distinct n-grams with their counts; these lists
are cut by hash into slices. A slice adds up the counts of all batches, which is its part of the count table,
and joins them back to the lists it was sent. With the counts the batch scores its documents.
What travels is one entry for each n-gram and batch, so a very common one is no hot key.
Batches and slices are as many as the corpus has pieces of BATCH_BYTES, so every task is bounded. A batch sends
lists to the slices it has grams of only, so lists grow with the n-grams and not with batches times slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribospark.llm.mixing import word_count
from tribospark.llm.text import byte_values, mixed

ORDER, BACKOFF = 2, 0.4
BATCH_BYTES = 12_000_000
#: What an n-gram that no other document has counts as, for single words.
UNSEEN = 0.5


def gram_hashes(text: bytes, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each word, for n = 1 to ``order``; A-Z count as lower case."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for w in text.lower().split()], np.uint64)
    out = [words]
    for n in range(1, order):
        out.append(mixed(out[-1][:-1], n) * np.uint64(3) ^ words[n:] if len(words) > n else words[:0])
    return out


def pack(sorted_: np.ndarray) -> bytes:
    """Differences of sorted numbers, byte plane by byte plane; the empty upper planes take no room once compressed."""
    steps = np.diff(sorted_, prepend=sorted_.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, steps.itemsize).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def batch_grams(texts: Iterator[bytes], order: int) -> tuple[list[list[np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """The n-grams of each text, and for each n the sorted distinct ones of all texts with their counts."""
    rows = [gram_hashes(text, order) for text in texts]
    return rows, [np.unique(np.concatenate([r[n] for r in rows]), return_counts=True) for n in range(order)]


def log_scores(rows: list[list[np.ndarray]], tables: list[tuple[np.ndarray, np.ndarray]], total: int, backoff: float) -> list[float]:
    """Summed log scores of each text; tables hold, for each n, the n-grams and their counts in the corpus.

    The text itself is left out of all counts. The longest n-gram that another document has gives
    count / count of its context, with a factor ``backoff`` for each shorter one; a lone word gives its share.
    """
    out = []
    for grams in rows:
        size = len(grams[0])
        rest = max(total - size, 1)
        other = []
        for hashes, (keys, counts) in zip(grams, tables):
            own, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
            other.append((counts[np.searchsorted(keys, own)] - times)[back])
        score = np.log(np.where(other[0] > 0, other[0], UNSEEN) / rest) if size else np.zeros(0)
        for n in range(1, len(grams)):
            if size <= n:
                break
            seen = other[n] > 0
            context = np.where(seen, other[n - 1][:-1], 1)
            longer = np.log(np.where(seen, other[n], 1) / context)
            score[n:] = np.where(seen, longer, score[n:] + np.log(backoff))
        out.append(float(score.sum()))
    return out


def score_documents(documents: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score): one row for each document.

    The counts are those of all other rows, copies included. Words end at ASCII white space. A null text counts as empty; a text without words scores
    0, with a null mean. A document that nothing else in the corpus resembles gets UNSEEN for each word. Other columns are ignored.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size, total = rows.agg(F.sum(F.octet_length("text")), F.sum(word_count(F.col("text")))).first()
    pieces, total = -(-int(size or 0) // BATCH_BYTES) or 1, int(total or 0)
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(pieces))).repartition("batch")
    # a gram's slice is read off the upper half of its hash, so that slices are stretches of the sorted grams
    slice_of = lambda keys: ((keys >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)

    def lists(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        _, grams = batch_grams((t for c in table.column("text").chunks for t in byte_values(c)), order)
        found = []
        for n, (keys, counts) in enumerate(grams):
            # only slices that the batch has grams of: lists are never more than grams, however many slices there are
            slices, starts = np.unique(slice_of(keys), return_index=True)
            for k, a, b in zip(slices.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                found.append((batch, n, k, pack(keys[a:b]), pack_counts(counts[a:b])))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*found)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["batch", "n", "slice", "grams", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        keys = [unpack(g.as_py()) for g in table.column("grams")]
        counts = np.concatenate([unpack_counts(c.as_py()) for c in table.column("counts")])
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(back, weights=counts).astype(np.int64)[back]
        ends = np.cumsum([len(k) for k in keys])
        answers = [pack_counts(part) for part in np.split(totals, ends[:-1])]
        return table.select(["batch", "n", "slice"]).append_column("counts", pa.array(answers, pa.binary()))

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        grams, tables = batch_grams((t for c in texts.column("text").chunks for t in byte_values(c)), order)
        answers: list[dict[int, np.ndarray]] = [{} for _ in range(order)]
        for n, k, data in zip(*(counts.column(c).to_pylist() for c in ("n", "slice", "counts"))):
            answers[n][k] = unpack_counts(data)
        known = [
            (keys, np.concatenate([a[k] for k in sorted(a)]) if a else np.zeros(0, np.int64))
            for (keys, _), a in zip(tables, answers)
        ]
        sizes = pa.array([len(g[0]) for g in grams], pa.int64())
        scores = pa.array(log_scores(grams, known, total, backoff), pa.float64())
        return pa.table([texts.column("doc_id"), sizes, scores], names=["doc_id", "n_tokens", "log_score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = dealt.groupBy("batch").applyInArrow(lists, "batch bigint, n int, slice bigint, grams binary, counts binary")
    answered = sent.groupBy("n", "slice").applyInArrow(add_up, "batch bigint, n int, slice bigint, counts binary")
    both = dealt.groupBy("batch").cogroup(answered.groupBy("batch"))
    found = both.applyInArrow(score, f"doc_id {kind}, n_tokens bigint, log_score double")
    return found.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))
