"""The registered queries of this subpackage: name -> (Spark query, SQL or None)."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribospark.llm import backoff_lm, bpe, embedding_dedup, host_rules, lexical_search, license_align, mixing, order_minhash, quality, simhash, tool_calls, toxicity, turn_alignment
from tribospark.llm.text import fold, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at cosine 0.95."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; every fifth id (by crc32) is held out."""
    documents, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.scored(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_tokens", F.size("passages").alias("n_passages"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str, path: str = "") -> DataFrame:
    """Ids of every document and their decoding, as digests."""
    vocabulary = bpe.read_vocabulary(path or public_tokenizers.path("word_bpe_49k.json"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(documents, vocabulary, keep_text=False, decoded="decoded").select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: What the calls that op4 derives from conversations may hold.
CALL_SCHEMAS = {
    name: {
        "type": "object", "required": ["text", "turn"], "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": longest}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "maximum": 60}},
    }
    for name, longest in (("reply", 300), ("configure", 200))
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chats without tool messages: a user or system turn calls for the assistant's next turn,
    and a call needs the one two turns before it."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    call = lambda shift: F.concat(F.lit("c"), (F.col("turn") - shift).cast("string"))
    words = F.size(F.split("text", " ")).alias("words")
    answers = F.col("role").eqNullSafe("assistant")  # a turn without a role calls, as a user's does
    calls = turns.where(~answers).select(
        "conv_id", call(0).alias("call_id"), "turn", F.when(F.col("role") == "system", "configure").otherwise("reply").alias("name"),
        F.to_json(F.struct("turn", "text", words)).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(call(2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = turns.where(answers).select("conv_id", call(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, linked, ordered, validated and written as canonical JSON."""
    return tool_calls.link(*conversation_calls(table(spark, sf_dir, "conversations")), CALL_SCHEMAS, every_row=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: 3-word shingles, 64 bits, linked at 3 differing bits."""
    found = simhash.groups(simhash.fingerprints(table(spark, sf_dir, "documents")), radius=3)
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; every third id (by crc32) is held out."""
    documents, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = quality.fit(documents, table(spark, sf_dir, "labels"), ~held_out)
    return quality.scored(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "margin"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    made = order_minhash.edited(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.hex_of(F.col("entries")).alias("fingerprint"),
        order_minhash.hex_of(F.col("edited_entries")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        order_minhash.likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
        "next_id",
    )


def op9_license_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements in every document; the one of the best coverage, then the longest, then the first."""
    found = license_align.scan_licenses(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("licenses", lambda x: F.struct(x["coverage"], (x["last"] - x["first"]).alias("span"), (-x["first"]).alias("at"), x["name"])))
    return found.select("doc_id", "n_words", F.size("licenses").alias("n_found"), best["name"].alias("license"), best["coverage"].alias("coverage"), "licenses")


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram score of every document under the counts of all others."""
    return backoff_lm.score_documents(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns as the contract damages them, by the crc32 of ``conv_id:turn``: dropped, emptied, without
    sentence ends, repeated, or said by the user. Nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(fault == 4, "user").otherwise(spaced("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    marked = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return marked.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")


def op11_turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired text of every damaged conversation."""
    conversations = table(spark, sf_dir, "conversations")
    edits, summary = turn_alignment.repair(damaged(conversations))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    texts = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    parts = conversations.select("conv_id").distinct().select("conv_id", *[null(c, "bigint") for c in counts], *[null(c, "string") for c in texts])
    parts = parts.unionByName(summary.select("conv_id", *counts, *[null(c, "string") for c in texts]))
    parts = parts.unionByName(turn_alignment.digests(edits).select("conv_id", *[null(c, "bigint") for c in counts], *texts))
    found = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*counts, *texts)])
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in texts.items()])


#: crc32 bit by bit; then the least (cost, audit) for each turn and last role, turn by turn.
TURN_ALIGNMENT_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), faulted AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS fault
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulted
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS kind
  FROM damaged
), turns AS (
  SELECT conv_id, turn, role, text, i, kind, lag(kind) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '.' END AS fault
  FROM placed
), facts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count_if(fault = 'b') AS BIGINT) AS blank, CAST(count_if(fault = 'd') AS BIGINT) AS duplicate,
    CAST(count_if(fault = 't') AS BIGINT) AS truncated, CAST(count_if(before || kind NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal
  FROM turns GROUP BY conv_id
), inserts AS (
  SELECT * FROM (VALUES ('-', 0, '-'), ('s', 0, 's'), ('u', 0, 'u'), ('a', 0, 'a'), ('-', 1, 'u'), ('s', 1, 'u'), ('u', 1, 'a'), ('a', 1, 'u'),
    ('-', 2, 'a'), ('s', 2, 'a'), ('u', 2, 'u'), ('a', 2, 'a')) AS t(old, k, new)
), moves AS (
  SELECT * FROM (VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a'),
    ('-', '', '-'), ('s', '', 's'), ('u', '', 'u'), ('a', '', 'a')) AS t(old, said, new)
), best AS (
  SELECT conv_id, 0::BIGINT AS i, '-' AS state, {'cost': 0::BIGINT, 'audit': ''} AS b FROM facts
  UNION ALL
  SELECT turns.conv_id, turns.i, moves.new, min({
    'cost': b.cost + 5 * k + CASE WHEN said = '' THEN 2 ELSE CASE WHEN fault = 't' THEN 5 ELSE 0 END + CASE WHEN said = kind THEN 0 ELSE 1 END END,
    'audit': b.audit || repeat('I', k) || CASE WHEN said = '' THEN 'D' WHEN said = kind THEN 'K' ELSE 'R' END})
  FROM best JOIN turns ON turns.conv_id IS NOT DISTINCT FROM best.conv_id AND turns.i = best.i + 1
    JOIN inserts ON inserts.old = state JOIN moves ON moves.old = inserts.new
  WHERE said = '' OR (fault NOT IN ('b', 'd') AND (said = kind OR said <> 's'))
  GROUP BY turns.conv_id, turns.i, moves.new
), repaired AS (
  SELECT best.conv_id, min({'cost': b.cost + 5 * k, 'audit': b.audit || repeat('I', k)}) AS b
  FROM best JOIN facts ON facts.conv_id IS NOT DISTINCT FROM best.conv_id AND facts.n = best.i JOIN inserts ON inserts.old = state
  WHERE inserts.new IN ('-', 'a') GROUP BY best.conv_id
), letters AS (
  SELECT conv_id, p, b.audit[p] AS edit, length(replace(b.audit[:p], 'I', '')) AS i, length(replace(b.audit[:p], 'D', '')) AS o
  FROM (SELECT conv_id, b, unnest(range(1, length(b.audit) + 1)) AS p FROM repaired)
), said AS (
  SELECT letters.*, role, text, bool_or(edit = 'K' AND kind = 's') OVER (PARTITION BY letters.conv_id) AS system
  FROM letters LEFT JOIN turns ON turns.conv_id IS NOT DISTINCT FROM letters.conv_id AND turns.i = letters.i
  WHERE edit <> 'D'
), hashed AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (o - CAST(system AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END,
    chr(10) ORDER BY p)) AS h
  FROM said GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashed ON hashed.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document, and whether its own text and its host (the source) pass."""
    judged = host_rules.judge(table(spark, sf_dir, "documents"), host="source")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


#: Windows are grouped by (document, five words); rates and the prior follow host_rules.beta_prior.
HOST_RULES_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT r, i, w[i:i+4] AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), counted AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (r)
), fails AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > n_words AS symbols,
    word_chars < 2 * n_words OR word_chars > 15 * n_words AS word_length, 10 * n_dup_lines > 3 * n_lines AS dup_lines
  FROM counted
), rules AS (
  UNPIVOT (SELECT host, short, repeats, symbols, word_length, dup_lines FROM fails WHERE host IS NOT NULL)
  ON short, repeats, symbols, word_length, dup_lines INTO NAME rule VALUE fails
), hosts AS (
  SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(fails) AS DOUBLE) AS f FROM rules GROUP BY host, rule
), moments AS (
  SELECT rule, count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum(f) / sum(n) AS m, sum(f * f / n) AS f2 FROM hosts GROUP BY rule
), spread AS (
  SELECT *, m * (1 - m) * (nn - n2 / nn - (k - 1)) AS room, f2 - nn * m * m - m * (1 - m) * (k - 1) AS excess FROM moments
), prior AS (
  SELECT rule, m, CASE WHEN room > 0 AND excess > 0 THEN least(greatest(room / excess - 1, 1), 1e6) ELSE 1e6 END AS strength FROM spread
), verdicts AS (
  SELECT host, bool_or((f + m * strength) / (n + strength) > 0.5) AS host_failed FROM hosts JOIN prior USING (rule) GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND NOT coalesce(host_failed, false) AS kept, coalesce(host_failed, false) AS host_failed
FROM fails LEFT JOIN verdicts USING (host)
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


LEXICAL_SEARCH_SQL = r"""
WITH tokens AS (
  SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
), asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), lengths AS (SELECT d, count(*) AS n FROM tokens GROUP BY d
), corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), postings AS (SELECT d, doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY d, doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM postings, corpus GROUP BY term
), impacts AS (
  SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact
  FROM postings JOIN lengths USING (d) JOIN weights USING (term), corpus
), scores AS (
  SELECT i, item_id, d, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY i, item_id, d, doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 50
"""


QUERIES = {
    "op1_embedding_dedup": (op1_embedding_dedup, None),
    "op2_toxicity": (op2_toxicity, None),
    "op3_bpe": (op3_bpe, None),
    "op4_tool_calls": (op4_tool_calls, None),
    "op5_simhash": (op5_simhash, None),
    "op6_quality": (op6_quality, None),
    "op7_mixing": (op7_mixing, None),
    "op8_order_minhash": (op8_order_minhash, None),
    "op9_license_align": (op9_license_align, None),
    "op10_backoff_lm": (op10_backoff_lm, None),
    "op11_turn_alignment": (op11_turn_alignment, TURN_ALIGNMENT_SQL),
    "op12_host_rules": (op12_host_rules, HOST_RULES_SQL),
    "op13_lexical_search": (op13_lexical_search, LEXICAL_SEARCH_SQL),
}
