"""Host-level quality rules: failures of simple text rules, judged by host.

Each document is held to a few rules. A host's failures of a rule are summed, and its failure rate is
shrunk towards the rate of all hosts by a beta prior that is itself estimated from the hosts: a host of
three documents tells little, one of a million speaks for itself. Documents of a host whose shrunken
rate passes ``max_rate`` for any rule go, whatever their own text looks like.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribospark.llm.text import byte_values
from tribospark.session import materialise

#: Words in a repeated window.
WINDOW = 5
#: A host fails if it breaks a rule in more than this share of its documents, after shrinking.
MAX_RATE = 0.5
#: Pseudo-documents of the prior: as few if hosts differ as much as they can, as many if they don't differ at all.
WEAKEST, STRONGEST = 1.0, 1e6
#: Copies of a failed host's verdict, met by salted documents, so that a host of a third of all rows is no single key.
SALTS = 32

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside at least one window of ``window`` words that occurs twice or more; each word counts once.

    Windows are told apart exactly: words are numbered, then pairs of numbers, by sorting. Memory is
    a few 64-bit numbers for each word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = dict.fromkeys(words)
    if len(number) == len(words):
        return 0
    for i, word in enumerate(number):
        number[word] = i
    single = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    span = single[:n]
    for shift in range(1, window):
        _, span = np.unique(span * len(number) + single[shift : shift + n], return_inverse=True)
    again = np.bincount(span)[span] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def text_counts(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text. Lines are cut at line feeds, and count if they hold a word."""
    words = text.split()  # bytes split at exactly the six white-space bytes of the word rule
    lines = [line for line in text.split(b"\n") if not line.isspace() and line]
    return (
        len(words),
        len(text.translate(None, SPACES + CONTINUED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def with_counts(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts of each whole text; a null text counts as empty."""
    kept = documents.select(*keep, F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(value) for value in byte_values(batch.column(len(keep)))]
            columns = zip(*rows, strict=True) if rows else repeat((), len(COUNTS))
            counts = [pa.array(column, pa.int64()) for column in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *counts], [*keep, *COUNTS])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(count, f"{head}, " + ", ".join(f"{name} bigint" for name in COUNTS))


def base_failed() -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name -> whether a document fails the rule; whole numbers only, so that any engine agrees."""
    words, spelled = F.col("n_words"), F.col("word_chars")
    return {
        "short": words < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * words,
        "symbols": 10 * F.col("n_symbols") > words,
        "word_length": (spelled < 2 * words) | (spelled > 15 * words),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def beta_prior(hosts: int, n: int, fails: int, n2: int, f2_over_n: float) -> tuple[float, float]:
    """(alpha, beta) by the moments of rates seen in groups of unequal size (Kleinman, 1973).

    From the number of hosts and the sums of documents, failures, documents squared and failures
    squared over documents. Where rates vary no more than chance allows, or there is one host or
    one outcome only, the strongest prior at the common rate stands.
    """
    mean = fails / n if n else 0.0
    between, chance = f2_over_n - n * mean * mean, mean * (1 - mean)
    room = chance * (n - n2 / n - (hosts - 1)) if n else 0.0
    alike = (between - chance * (hosts - 1)) / room if room > 0 else 0.0
    strength = 1 / alike - 1 if alike > 0 else STRONGEST
    strength = min(max(strength, WEAKEST), STRONGEST)
    return mean * strength, (1 - mean) * strength


def host_verdicts(documents: DataFrame, host: str = "host", max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n_docs, for each rule fails_<rule> and rate_<rule>, failed) from documents with their counts.

    Sums are partial before the shuffle, so a host of any size sends one row from each task. Null is
    no host. The prior comes from one row of sums.
    """
    tests = rules()
    fails = [F.count_if(test).alias(f"fails_{name}") for name, test in tests.items()]
    hosts = documents.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *fails)
    hosts = materialise(hosts)
    n = F.col("n_docs").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum("n_docs").alias("n"), F.sum(n * n).alias("n2")]
    for name in tests:
        f = F.col(f"fails_{name}")
        sums += [F.sum(f).alias(f"f_{name}"), F.sum(f * f / n).alias(f"f2_{name}")]
    total = hosts.agg(*sums).first()
    rates = {}
    for name in tests:
        alpha, beta = beta_prior(total["hosts"], total["n"] or 0, total[f"f_{name}"] or 0, total["n2"] or 0, total[f"f2_{name}"] or 0.0)
        rates[f"rate_{name}"] = (F.col(f"fails_{name}") + alpha) / (n + (alpha + beta))
    hosts = hosts.withColumns(rates)
    return hosts.withColumn("failed", F.greatest(*[F.col(rate) for rate in rates], F.lit(-math.inf)) > max_rate)


def judge(documents: DataFrame, host: str = "source", keep: tuple[str, ...] = ("doc_id",), text: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """The columns ``keep``, the counts, base_failed, host_failed and kept, a row for every row of ``documents``.

    kept is false if the document fails a base rule (too short, repeats) or its host fails. A document
    without host is judged by the base rules alone. Null and empty texts have zero counts and fail as
    too short. Equal ids and repeated rows are judged each; an empty table gives no rows; other
    columns, whatever their names, are left behind. Only failed hosts travel to the join, in ``SALTS``
    copies, and documents meet them by (host, salt).
    """
    named = documents.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    keys = [f"_k{i}" for i in range(len(keep))]
    counted = materialise(with_counts(named, keep=(*keys, "host")))
    failed = host_verdicts(counted, max_rate=max_rate).where("failed").select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("_failed"))
    salt = F.pmod(F.xxhash64(*keys, *COUNTS), F.lit(SALTS)).cast("int")
    out = counted.withColumn("_salt", salt).join(materialise(failed), ["host", "_salt"], "left")
    host_failed = F.coalesce("_failed", F.lit(False))
    return out.select(
        *[F.col(k).alias(c) for k, c in zip(keys, keep, strict=True)], *COUNTS,
        base_failed().alias("base_failed"), host_failed.alias("host_failed"), (~base_failed() & ~host_failed).alias("kept"),
    )
