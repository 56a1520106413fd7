"""Ranked lexical search: term-at-a-time over a document-partitioned index, with limited accumulators.

Queries are dealt with in blocks of bounded vocabulary. For a block, every document is reduced once to
the terms it shares with the block (written; counts of documents and terms come from that table). Then
each task indexes its documents, a bounded shard at a time, and runs every query over the shard:
rarest term first, a score slot for each document met. Once the best that all remaining terms could
add falls below the k-th partial score, documents without a slot can't enter, so no slot is added;
those that have one get the rest of their score. A task hands on k documents for each query, and the
best k of all tasks are the answer. Scores are whole numbers and equal those of a full evaluation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribospark.llm.text import byte_values
from tribospark.session import materialise

#: Distinct terms of a block of queries; the vocabulary of a block is sent to the tasks (some 100 bytes a term).
BLOCK_TERMS = 100_000
#: Items of a block, and their terms counted with repeats, as a multiple of BLOCK_TERMS.
BLOCK_ITEMS, REPEATS = 4096, 10
#: Bytes of a long text that are cut into terms at once.
PIECE = 1 << 22
#: Documents and postings of a shard, which is what a task holds at a time.
SHARD_DOCS, SHARD_POSTINGS = 32_768, 4_000_000
#: Tasks' results are merged by this many groups first.
MERGES = 64
SCALE = 1_000_000_000

#: A term byte stays (A-Z as a-z), any other becomes a space: 0-9, A-Z, a-z and all of UTF-8 beyond ASCII.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Terms in order. After the translation a space is the only white space among the bytes."""
    return text.translate(TERM_BYTES).split()


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text of any length, some million bytes at a time."""
    text, start = text.translate(TERM_BYTES), 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 50 + (50 n N) div L, exact also where the product passes 64 bits."""
    longest = int(n.max()) if len(n) else 0
    if 50 * longest * n_docs < 2**63:
        return 50 + (50 * n * n_docs) // n_terms
    return np.array([50 + (50 * int(x) * n_docs) // n_terms for x in n], np.int64)


class Best:
    """The k best (score, id) of a query so far: by score, then by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """Score that a document must at least tie with to enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(pair) for pair in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


class Shard:
    """Postings of some documents by term, with the impact (1e9 tf) div (1000 tf + 20 m) of each."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, factor: np.ndarray, docs: np.ndarray, terms: np.ndarray, tf: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.ids, self.null, self.docs = ids, null, docs[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        tf = tf[order]
        self.impact = SCALE * tf // (1000 * tf + 20 * factor[self.docs])
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(order) else self.impact

    def search(self, query: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Adds the shard's documents to ``best``; query holds distinct terms, rarest first. Returns the slots made."""
        at = np.searchsorted(self.terms, query)
        here = np.flatnonzero(at < len(self.terms))
        here = here[self.terms[at[here]] == query[here]]
        at, weights = at[here], weights[here]
        rest = np.append(np.cumsum((weights * self.most[at])[::-1])[::-1], 0)
        score = np.zeros(len(self.ids), np.int64)
        slots, open_ = np.zeros(0, np.int64), True
        for i, (term, w) in enumerate(zip(at, weights, strict=True)):
            docs, impact = self.docs[self.starts[term] : self.ends[term]], self.impact[self.starts[term] : self.ends[term]]
            if open_ and rest[i] < self._bar(score, slots, best):
                open_ = False
            if open_:
                slots = np.concatenate([slots, docs[(score[docs] == 0) & (w * impact > 0)]])
            else:
                survive = score[docs] > 0
                docs, impact = docs[survive], impact[survive]
            score[docs] += w * impact
        slots = slots[score[slots] >= best.least()]
        best.add(score[slots], self.ids[slots], self.null[slots])
        return len(slots)

    @staticmethod
    def _bar(score: np.ndarray, slots: np.ndarray, best: Best) -> int:
        """A new document must reach the k-th of the partial scores here, and of what earlier shards hold."""
        if len(slots) < best.k:
            return best.least()
        return max(best.least(), int(np.partition(score[slots], -best.k)[-best.k]))


def _sparse(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf): length of each document, and its terms that are in the vocabulary."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ends, terms, counts = [], [0], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for text in byte_values(batch.column(1)):
                n, found = 0, [np.zeros(0, np.int32)]
                for words in pieces(text):
                    n += len(words)
                    known = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))
                    found.append(known[known >= 0])
                term, count = np.unique(np.concatenate(found), return_counts=True)
                lengths.append(n)
                ends.append(ends[-1] + len(term))
                terms.append(term)
                counts.append(count)
            offsets = pa.array(ends, pa.int32())
            columns = [
                batch.column(0), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(terms), pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts), pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tf"])

    return documents.mapInArrow(reduce, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")


def _searched(sparse: DataFrame, queries: list[tuple[int, np.ndarray]], df: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): the best k of each task for each query."""
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    plans = []
    for query, terms in queries:
        order = terms[np.lexsort((terms, df[terms]))]  # rarest first
        plans.append((query, order, weights[order]))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, postings = rows + batch.num_rows, postings + len(batch.column(2).flatten())
            if rows >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, postings = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(k) for _ in plans]
        for table in shards(batches):
            if not table.num_rows:
                continue
            ids, n, lists, tf = (column.chunk(0) for column in table.columns)
            sizes = np.diff(lists.offsets.to_numpy())
            shard = Shard(
                ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                length_factor(n.to_numpy(), n_docs, n_terms), np.repeat(np.arange(len(ids)), sizes),
                lists.flatten().to_numpy(), tf.flatten().to_numpy(),
            )
            for best, (_, terms, w) in zip(bests, plans, strict=True):
                shard.search(terms, w, best)
        found = [(plan[0], best) for plan, best in zip(plans, bests, strict=True) if len(best.scores)]
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(b.scores), q) for q, b in found]), pa.int32()),
                    pa.array(np.concatenate([b.ids for _, b in found]), pa.int64(), mask=np.concatenate([b.null for _, b in found])),
                    pa.array(np.concatenate([b.scores for _, b in found]), pa.int64()),
                ],
                ["query", "doc_id", "score"],
            )

    return sparse.mapInArrow(search, "query int, doc_id bigint, score bigint")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each group with their rank; Spark cuts each task's rows to k before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, read one after the other, in blocks of bounded vocabulary."""
    block, seen, total = [], set(), 0
    for item, text in items.toLocalIterator():
        terms = list(dict.fromkeys(terms_of((text or "").encode())))
        full = len(block) >= BLOCK_ITEMS or total + len(terms) > REPEATS * block_terms
        if block and (full or len(seen.union(terms)) > block_terms):
            yield block
            block, seen, total = [], set(), 0
        block.append((item, terms))
        seen.update(terms)
        total += len(terms)
    if block:
        yield block


def search(
    documents: DataFrame, items: DataFrame, k: int = 50, doc_id: Column | str = "doc_id", text: str = "text", item_id: str = "item_id", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents with a score above 0.

    Ranks are unique; equal scores go by ascending id, null ids last. Null and empty texts have no
    terms: as a document they don't count, as an item they find nothing. Repeated documents each take a
    rank, repeated items each get an answer, also where their ids are equal or null. A table without
    terms gives no rows. Columns are taken by name, others don't matter. Ids must be whole numbers.

    Work is one pass over the texts for each block of items (100 000 distinct terms at most), and the search
    reads only the terms that the block shares with them. Of the corpus, the driver sees one count for
    each term of the block.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id") if isinstance(doc_id, str) else doc_id.cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    answers = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in _blocks(items.select(item_id, "text"), block_terms):
        vocabulary = {term: i for i, term in enumerate(dict.fromkeys(t for _, terms in block for t in terms))}
        sparse = materialise(_sparse(docs, vocabulary))
        n_docs, n_terms = sparse.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in sparse.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[term] = n
        queries = [(i, np.array([vocabulary[t] for t in terms], np.int64)) for i, (_, terms) in enumerate(block)]
        found = _searched(sparse, queries, df, n_docs, n_terms, k)
        found = _best(found.withColumn("part", F.spark_partition_id() % MERGES), ["query", "part"], k).drop("rank", "part")
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, item_id {kind}")
        found = materialise(_best(found, ["query"], k)).join(names, "query")
        answers = answers.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return answers
