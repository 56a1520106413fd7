"""Order MinHash fingerprints of documents (Marcais et al., 2019), with built-in functions only.

A k-mer is a word with the words before it. Each is numbered by its occurrence, so that repeats count,
and hashed. The hash space is cut into bins, one for each part of the signature (one permutation for all);
of each bin the smallest k-mers are kept, put in the order of the text and hashed as a tuple. Two
documents agree in a bin if they share its smallest k-mers in the same order, so both edits and moves
tell. All steps are arrays within a row: sorting takes n log n, the rest is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribospark.llm.text import WORD
from tribospark.session import materialise

#: Words of a k-mer, and bins of a fingerprint as a power of two.
WORDS, BIN_BITS = 3, 6
#: A sorted k-mer is its hash in the upper bits over its position, which is counted up to 2^24 - 1.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often the body, or a lambda in it, refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))


def _starts(values: Column, key: Callable[[Column], Column]) -> Column:
    """Positions in a sorted array at which another key begins."""
    return F.filter(_places(values), lambda i: ~key(F.get(values, i)).eqNullSafe(key(F.get(values, i - 1))))


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place.cast("bigint"))


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _bin_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - BIN_BITS)


def signature(text: Column) -> Column:
    """array<int>, an entry for each bin in use: bin * 65536 + a 16-bit hash of its ordered k-mers."""

    def kmers(words: Column) -> Column:
        window = lambda w, i: F.xxhash64(*[F.get(words, i - back) for back in range(WORDS - 1, 0, -1)], w)
        return F.transform(words, lambda w, i: _packed(window(w, i), F.least(i, F.lit(PLACE))))

    def numbered(sorted_: Column) -> Column:
        def runs(starts: Column) -> Column:
            def one(start: Column, j: Column) -> Column:
                end = F.coalesce(F.get(starts, j + 1), F.size(sorted_))
                run = F.slice(sorted_, start + 1, end - start)
                return F.transform(run, lambda x, nth: _packed(F.xxhash64(_hash_of(x), nth), x.bitwiseAND(F.lit(PLACE)).cast("int")))

            return F.flatten(F.transform(starts, one))

        return let(_starts(sorted_, _hash_of), runs)

    def binned(sorted_: Column) -> Column:
        def entry(i: Column) -> Column:
            a, b = F.get(sorted_, i), F.get(sorted_, i + 1)
            place = lambda x: x.bitwiseAND(F.lit(PLACE))
            alone = ~_bin_of(a).eqNullSafe(_bin_of(b))
            pair = F.when(alone, F.xxhash64(_hash_of(a))).when(
                place(a) <= place(b), F.xxhash64(_hash_of(a), _hash_of(b))
            ).otherwise(F.xxhash64(_hash_of(b), _hash_of(a)))
            return (_bin_of(a) * 65536 + F.pmod(pair, F.lit(65536))).cast("int")

        return F.transform(_starts(sorted_, _bin_of), entry)

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    hashed = let(words, lambda w: F.sort_array(kmers(w)))
    return let(let(hashed, lambda s: F.sort_array(numbered(s))), binned)


def hex_of(entries: Column) -> Column:
    """The signature as text: two hexadecimal digits for the bin and four for its hash, in the order of the hash space."""
    return F.lower(F.array_join(F.transform(entries, lambda e: F.lpad(F.hex(e), 6, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those in use by either; 1 if both have none."""
    bins = lambda entries: F.transform(entries, lambda e: F.shiftright(e, 16))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(bins(a), bins(b)))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(1.0))


def successors(documents: DataFrame) -> DataFrame:
    """(doc_id, next_id, need): the next smaller id, after the last the first; null counts as smallest.

    ``need`` is the most characters that a document of this id takes from the next one. Ids are sorted
    by range partitions; each partition's last id is followed by the next partition's first. The only
    window without a key sees one row for each partition.
    """
    ids = documents.groupBy("doc_id").agg(F.max("half").alias("need"))
    down = F.desc_nulls_last("doc_id")
    parts = materialise(ids.repartitionByRange(down).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(down)
    ordered = parts.withColumns({"follows": F.lead(F.struct("doc_id")).over(inside), "place": F.row_number().over(inside)})
    heads = ordered.where("place = 1").select("part", F.struct("doc_id").alias("head"))
    line = Window.orderBy("part")
    after = F.coalesce(F.lead("head").over(line), F.first("head").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    after = heads.select("part", after.alias("after"))
    found = ordered.join(after, "part").withColumn("next", F.coalesce("follows", "after"))
    return found.select("doc_id", F.col("next.doc_id").alias("next_id"), "need")


def _key(doc_id: Column) -> Column:
    """The id as text that is never null, so that joins on it keep the partitioning by it."""
    return F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit(""))


def edited(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, entries, edited_entries, next_id, next_entries): one row for each document.

    ``edited`` is the text whose last floor(n / 2) code points are replaced by the first as many, or all,
    of the next document by descending doc_id, after the last the first. A null text counts as empty.
    Rows of one doc_id share the next document; if that id has several rows, the smallest text is taken.
    A null doc_id comes last. Other columns are ignored.
    """
    text, half = F.coalesce("text", F.lit("")), lambda t: F.floor(F.length(t) / 2).cast("int")
    rows = documents.select("doc_id", text.alias("text"))
    links = materialise(successors(rows.select("doc_id", half("text").alias("half"))))
    # One shuffle of the texts by key serves both sides, as documents and as those that follow another;
    # for that both read the same columns.
    dealt = rows.select(_key(F.col("doc_id")).alias("key"), "doc_id", "text", signature(F.col("text")).alias("entries")).repartition("key")
    to = links.select(_key(F.col("next_id")).alias("key"), _key(F.col("doc_id")).alias("to"), "need")
    given = F.struct(F.substring("text", F.lit(1), F.col("need")).alias("prefix"), F.col("doc_id").alias("next_id"), F.col("entries").alias("next_entries"))
    given = dealt.join(to, "key").select(F.col("to").alias("key"), given.alias("given"))
    if rows.count() > links.count():  # repeated ids only: one text for each
        given = given.groupBy("key").agg(F.min("given").alias("given"))
    both = dealt.join(given, "key")
    keep = F.substring("text", F.lit(1), F.length("text") - half("text"))
    new = F.concat(keep, F.substring("given.prefix", F.lit(1), half("text")))
    made = both.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), new.alias("edited"), "entries", "given.next_id", "given.next_entries")
    return made.withColumn("edited_entries", signature(F.col("edited")))
