"""SimHash near-duplicates: fingerprints, candidate cells, bit-sliced comparison, groups.

Any pair within the radius meets in a cell. With ``pigeonhole`` cells that is certain: the bits are
split into radius + m parts, and two fingerprints that differ in ``radius`` bits agree in m of them.
With ``minwise`` cells (for wide radii, where no such split is selective) it is as likely as the
documents' shingles are alike; what they find are candidates, and ``alike`` compares the shingle sets.
Cells are cut into blocks of a fixed size, so a hot cell is many tasks.
A block pair returns a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate, combinations
from math import acos, comb, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tribospark.llm.bitslice import close_pairs, forest
from tribospark.llm.components import components
from tribospark.llm.text import byte_values, mixed
from tribospark.session import materialise

#: Fingerprints of a block; a task compares two blocks.
BLOCK = 2048
#: Shingles whose bits are summed at once, which bounds a task's memory for very long texts.
SUM_ROWS = 65536
#: Characters of the texts of a block whose shingle sets are compared.
BLOCK_CHARS = 1 << 23
#: Sets whose common shingles are counted at once.
RUN = 256
SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words (of the whole sequence if there are fewer), repeats included."""
    parts = text.lower().split()  # bytes: lower-cases A-Z only, splits at 0x20 and 0x09-0x0D only
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    size = min(words, len(parts))
    starts = [0, *ends[:-size]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(starts))


def simhash(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit words; a bit is 1 if it is set in over half of the hashes. No hashes give zero.

    The first word takes the bits of the hashes themselves, each further one those of a re-mixed hash.
    """
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        bits = np.zeros(64, np.int64)
        for at in range(0, len(hashes), SUM_ROWS):
            part = hashes[at : at + SUM_ROWS]
            part = np.ascontiguousarray(mixed(part, 1000 + lane) if lane else part, dtype="<u8")
            bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0]
    return out


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band: a hash of ``rows`` minima over the shingles, each under another odd factor."""
    factors = mixed(np.arange(bands * rows, dtype=np.uint64), 5) | np.uint64(1)
    least = np.zeros(bands * rows, np.uint64)
    if len(hashes):
        turned = np.empty_like(hashes)
        for k, factor in enumerate(factors):
            least[k] = np.multiply(hashes, factor, out=turned).min()
    keys = np.zeros(bands, np.uint64)
    for row in range(rows):
        keys = mixed(keys ^ least[row::rows], row)
    return keys


def set_digest(hashes: np.ndarray) -> np.ndarray:
    """Two words that stand for a set of hashes (sorted, without repeats)."""
    return np.frombuffer(blake2b(hashes.tobytes(), digest_size=16).digest(), "<i8")


def fingerprints(documents: DataFrame, words: int = 3, lanes: int = 1, bands: int = 0, rows: int = 4, sets: bool = False) -> DataFrame:
    """(doc_id, fp array<long>, keys array<long>): one row for each document.

    With ``sets`` a repeated shingle counts once, and fp ends with two more words, a digest of the shingle set.

    A null text counts as empty; a text without words has the fingerprint zero. Other columns are
    ignored. Only doc_id and text are read.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for text in byte_values(batch.column("text")):
                hashes = shingle_hashes(text, words)
                own = np.unique(hashes)
                fp = simhash(own if sets else hashes, lanes).view(np.int64)
                fps.append(np.concatenate([fp, set_digest(own)]) if sets else fp)
                keys.append(band_keys(own, bands, rows).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), *map(batch.column, extra)],
                names=["doc_id", "fp", "keys", *extra],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema, columns, extra = f"doc_id {kind}, fp array<bigint>, keys array<bigint>", ["doc_id", "text"], []
    if sets:  # what finds the text again
        schema, extra = f"{schema}, text_key bigint, chars bigint", ["text_key", "chars"]
        columns += [text_key().alias("text_key"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars")]
    return documents.select(*columns).mapInArrow(make, schema)


def text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def pigeonhole_cells(prints: DataFrame, radius: int, n: int) -> DataFrame:
    """(fp, cell): every fingerprint once for each choice of parts that must agree.

    The number of parts is the smallest whose keys keep a cell near one block, so it grows slowly with
    the number of fingerprints: one of four 16-bit parts up to about 10^8, two of five beyond.
    Keys are hashed to about n / BLOCK cells for each choice; a cell then holds whole keys.
    """
    agree = next(m for m in range(1, 64 - radius) if m == 63 - radius or n >> (64 * m // (radius + m)) < BLOCK)
    parts = radius + agree
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [sum(((1 << edges[p + 1]) - 1) ^ ((1 << edges[p]) - 1) for p in chosen) for chosen in combinations(range(parts), agree)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = max(1, -(-n // BLOCK))
    choice = F.explode(
        F.array(
            *[
                (F.pmod(F.xxhash64(F.col("fp")[0].bitwiseAND(F.lit(m)), F.lit(t)), F.lit(cells)) + t * cells)
                for t, m in enumerate(signed)
            ]
        )
    )
    assert len(masks) == comb(parts, agree)
    return prints.select("fp", choice.alias("cell"))


def minwise_cells(prints: DataFrame) -> DataFrame:
    """(fp, cell): every fingerprint once for each of its bands; documents of equal fingerprints share theirs."""
    key = F.posexplode("keys").alias("band", "key")
    return prints.select("fp", key).select("fp", F.xxhash64("band", "key").alias("cell")).distinct()


def linked(cells: DataFrame, radius: int, lanes: int = 1) -> DataFrame:
    """(a, b) links that span, for each pair of blocks of a cell, all fingerprints within ``radius`` in their first ``lanes`` words.

    Cells are cut into ceil(size / BLOCK) blocks by a hash of the fingerprint. Small cells travel
    together: the tasks group by a bucket of cells, and compare within each cell.
    """
    sizes = cells.groupBy("cell").count().where(F.col("count") > 1)
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    dealt = (
        cells.join(sizes, "cell")
        .select("cell", "fp", blocks.alias("n"), "count")
        .withColumn("own", own)
        .withColumn("other", other)
        .select(
            "cell", "fp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("count") < BLOCK // 8, F.pmod(F.xxhash64("cell"), F.lit(1 << 30))).alias("small"),
        )
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        words = np.array(frame["fp"].tolist(), dtype=np.int64).view(np.uint64)
        i, j, own = int(frame["i"].iloc[0]), int(frame["j"].iloc[0]), frame["own"].to_numpy()
        left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        a, b = close_pairs(words[left, :lanes], words[right, :lanes], radius)
        a, b = left[a], right[b]
        at = forest(len(words), a, b)
        moved = np.nonzero(at != np.arange(len(words)))[0]
        ends = {"a": frame["fp"].iloc[moved].tolist(), "b": frame["fp"].iloc[at[moved]].tolist()}
        return pd.DataFrame(ends, dtype=object)

    def compare_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell. Whole cells are put together to about a block, as any close pair in it is a link."""
        cell, rows = None, []
        for batch in batches:
            for c, fp in zip(batch.column("cell").to_pylist(), batch.column("fp").to_pylist()):
                if c != cell and len(rows) >= BLOCK:
                    yield from cells_together(rows)
                    rows = []
                cell = c
                rows.append(fp)
        yield from cells_together(rows)

    def cells_together(rows: list) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        words = np.unique(np.array(rows, dtype=np.int64), axis=0)
        heads = words[:, :lanes].view(np.uint64)
        a, b = close_pairs(heads, heads, radius)
        at = forest(len(words), a, b)
        moved = np.nonzero(at != np.arange(len(words)))[0]
        if len(moved):
            kind = pa.list_(pa.int64())
            ends = [pa.array(list(words[moved]), kind), pa.array(list(words[at[moved]]), kind)]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    kind = "a array<bigint>, b array<bigint>"
    large = dealt.where(F.col("small").isNull()).groupBy("cell", "i", "j").applyInPandas(compare, kind)
    small = (
        dealt.where(F.col("small").isNotNull())
        .select("cell", "fp", "small")
        .repartition("small", "cell")
        .sortWithinPartitions("cell")
        .mapInArrow(compare_many, kind)
    )
    return large.unionByName(small)


def alike(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Smallest position reachable from each set over those pairs (a, b) whose Jaccard similarity is at least ``similarity``.

    ``sets`` hold sorted hashes without repeats. Pairs that links already join are not counted out.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    root = np.arange(len(sets))
    low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    able = (a != b) & (low > 0) & (low >= similarity * high - 1e-6)  # the common part is the smaller set at most
    a, b = np.minimum(a, b)[able], np.maximum(a, b)[able]
    if not len(a):
        return root
    used = np.unique(np.concatenate([a, b]))
    values, ids = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    parts = dict(zip(used.tolist(), np.split(ids.astype(np.int32), np.cumsum(sizes[used])[:-1])))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts = np.nonzero(np.r_[True, a[1:] != a[:-1]])[0]
    seen = np.zeros(len(values), bool)
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(a)]):
        i = int(a[start])
        seen[parts[i]] = True
        for at in range(start, end, RUN):
            others = np.unique(b[at : min(at + RUN, end)])
            others = others[root[others] != root[i]]
            if len(others):
                edges = np.r_[0, np.cumsum(sizes[others])[:-1]]
                common = np.add.reduceat(seen[np.concatenate([parts[j] for j in others.tolist()])].astype(np.int64), edges)
                met = others[common / (sizes[others] + sizes[i] - common) >= similarity]
                if len(met):
                    trees = np.unique(root[[i, *met.tolist()]])
                    root[np.isin(root, trees)] = trees[0]
        seen[parts[i]] = False
    return root


def alike_links(texts: DataFrame, radius: int, lanes: int, words: int, similarity: float) -> DataFrame:
    """(a, b) links that span all fingerprints of a candidate group whose shingle sets have this Jaccard similarity.

    ``texts``: group, fp, text, n (blocks of the group). As in ``linked``, groups are cut into blocks, small groups travel
    together, and only pairs within ``radius`` are compared. A block has about BLOCK fingerprints and BLOCK_CHARS characters at most; texts are bytes.
    """
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    large = texts.where("n > 1").withColumn("own", own).withColumn("other", other)
    large = large.select("group", "fp", "text", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def found(fps: list, texts: list, own: list | None = None, i: int = 0, j: int = 0) -> Iterator[pa.RecordBatch]:
        fp, first = np.unique(np.array(fps, dtype=np.int64), axis=0, return_index=True)
        heads = np.ascontiguousarray(fp[:, :lanes]).view(np.uint64)
        place = np.zeros(len(fp), int) if own is None else np.array(own)[first]
        left, right = np.nonzero(place == i)[0], np.nonzero(place == j)[0]
        if len(fp) < 2 or not len(left) or not len(right):
            return
        a, b = close_pairs(heads[left], heads[right], radius)
        a, b = left[a], right[b]
        needed = np.zeros(len(fp), bool)
        needed[a[a != b]] = needed[b[a != b]] = True
        none = np.zeros(0, np.uint64)
        sets = [np.unique(shingle_hashes(texts[k], words)) if need else none for k, need in zip(first, needed)]
        at = alike(sets, a, b, similarity)
        moved = np.nonzero(at != np.arange(len(fp)))[0]
        if len(moved):
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(fp[moved]), kind), pa.array(list(fp[at[moved]]), kind)], names=["a", "b"])

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        ends = {"a": [], "b": []}
        for batch in found(frame["fp"].tolist(), frame["text"].tolist(), frame["own"].tolist(), i, j):
            ends = {n: batch.column(n).to_pylist() for n in ends}
        return pd.DataFrame(ends, dtype=object)

    def compare_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps, texts, chars = None, [], [], 0
        for batch in batches:
            for g, fp, text in zip(batch.column("group"), batch.column("fp"), batch.column("text")):
                g = g.as_py()
                if g != group and (len(fps) >= BLOCK or chars >= BLOCK_CHARS):
                    yield from found(fps, texts)
                    fps, texts, chars = [], [], 0
                group, text = g, text.as_py()
                fps.append(fp.as_py())
                texts.append(text)
                chars += len(text)
        if fps:
            yield from found(fps, texts)

    kind = "a array<bigint>, b array<bigint>"
    small = texts.where("n = 1").select("group", "fp", "text").repartition("group").sortWithinPartitions("group")
    return large.groupBy("group", "i", "j").applyInPandas(compare, kind).unionByName(small.mapInArrow(compare_many, kind))


def alike_groups(documents: DataFrame, words: int, similarity: float, lanes: int, bands: int, rows: int, radius: int) -> DataFrame:
    """(doc_id, fp, component_id): one row for each document; documents link if their shingle sets have this Jaccard similarity.

    Fingerprints within ``radius`` that share a band are candidates only. Each group that candidates connect is compared
    by its texts, which travel once for each block of the group. Equal shingle sets are compared once.
    """
    prints = materialise(fingerprints(documents, words, lanes, bands, rows, sets=True))
    rep = F.min(F.struct("doc_id", "text_key", "chars")).alias("rep")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), rep))
    near = materialise(components(linked(minwise_cells(prints), radius, lanes)).withColumnRenamed("node", "fp"))
    members = near.join(distinct.select("fp", "rep.*"), "fp").withColumn("group", F.xxhash64("component"))
    sizes = members.groupBy("group").agg(F.count("*").alias("count"), F.sum("chars").alias("all"))
    blocks = F.ceil(F.greatest(F.col("count") / BLOCK, F.col("all") / BLOCK_CHARS, F.lit(1.0))).cast("int")
    members = materialise(members.join(sizes, "group").select("group", "fp", F.col("doc_id").alias("id"), "text_key", blocks.alias("n")))
    there = documents.select(F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), text_key().alias("key"))
    same = there["doc_id"].eqNullSafe(members["id"]) & (there["key"] == members["text_key"])
    texts = there.join(members, same).select("group", "fp", "text", "n")
    return named(prints, distinct, components(alike_links(texts, radius, lanes, words, similarity)))


def groups(prints: DataFrame, radius: int) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``prints``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id that
    links reach, null only if all ids reached are null. Equal fingerprints are compared once.
    """
    prints = materialise(prints)
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return named(prints, distinct, components(linked(pigeonhole_cells(distinct, radius, distinct.count()), radius)))


def named(prints: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of ``prints``: the smallest doc_id of all that ``links`` (node, component) put together."""
    known = (
        distinct.select("fp", "least")
        .join(links.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("component"))
    )
    low = known.groupBy("component").agg(F.min("least").alias("component_id"))
    found = known.join(low, "component").select("fp", "component_id")
    return prints.select("doc_id", "fp").join(found, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp) -> F.Column:
    """16 lowercase hexadecimal digits for each word."""
    return F.lower(F.array_join(F.transform(fp, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def radius_of(similarity: float, lanes: int) -> int:
    """Differing bits, of ``lanes`` words, that hold all but some 1 in 10^5 pairs of shingle sets of this Jaccard similarity.

    Sets of equal size are the farthest. Small sets differ by more than the angle says (4 against 5 shingles in 3 bits of 16),
    hence a quarter on top of the angle, and 4.5 standard deviations.
    """
    share = 1.25 * acos(2 * similarity / (1 + similarity)) / pi
    bits = lanes * 64
    return round(bits * share + 4.5 * (bits * share * (1 - share)) ** 0.5)


def one_of_each(documents: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 8, bands: int = 25) -> DataFrame:
    """The documents without near-copies: of each group the one with the smallest doc_id, all columns as they were.

    Documents are near if the sets of their ``words``-word shingles have at least this Jaccard similarity. Pairs are found by
    bands of minima and a wide radius of fingerprints, which together lose about 1 pair in 10^5 at the similarity itself, and
    decided by their sets. Rows of one doc_id are one document: the smallest text stays. Rows without a doc_id stay.
    """
    found = materialise(alike_groups(documents, words, similarity, lanes, bands, 4, radius_of(similarity, lanes)))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    stay = documents.join(gone, "doc_id", "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return stay.select(*documents.columns)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    named = stay.where(F.col("doc_id").isNotNull()).withColumn("__first", first).where("__first = 1")
    return named.select(*documents.columns).unionByName(stay.where(F.col("doc_id").isNull()).select(*documents.columns))
