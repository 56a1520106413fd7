"""Filters, tokens, fingerprints, licenses and scores of texts against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tribospark.llm import backoff_lm, bpe, license_align, order_minhash, quality, toxicity
from tribospark.llm.queries import QUERIES
from tribospark.llm.text import fold

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "ab", "É", "日本 語", "😀 😀", "x" * 60000, "word " * 20000, "same", "same"]


def odd_rows(spark, n_null_ids=1):
    rows = [(i, t, "clash", "clash", 1.0) for i, t in enumerate(ODD)] + [(11, "same", "c", "c", 0.0)] + [(None, "no id", None, None, None)] * n_null_ids
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, entries string, score double")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# --- toxicity ----------------------------------------------------------------------------------
def maximal_segments(scores):
    """By definition: the best segment (the shortest on ties), then the same on both sides of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > 0 and (best is None or total > best[0] or total == best[0] and j - i < best[2] - best[1]):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    return maximal_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in maximal_segments(scores[j:])]


@given(st.lists(st.integers(-3, 3), max_size=14))
@settings(max_examples=200, deadline=None)
def test_segments_are_the_maximal_ones(scores):
    # scores of 3.5 k + a drift of 1/2 are exact, and ties between whole segments don't occur
    scores = [7 * s + 1 / 64 * k for k, s in enumerate(scores)]
    hits = [(i, s + 0.5) for i, s in enumerate(scores)]
    got = [(a, b) for a, b, _ in toxicity.segments(hits, 0.5)]
    assert got == maximal_segments(scores)


def test_segments_bridge_neutral_words():
    assert toxicity.segments([(0, 4.0), (10, 4.0)], 0.1) == [(0, 11, pytest.approx(4.0 + 4.0 - 1.1))]
    assert [(a, b) for a, b, _ in toxicity.segments([(0, 4.0), (100, 4.0)], 0.1)] == [(0, 1), (100, 101)] and toxicity.segments([], 0.1) == []


def test_chance_decay_solves_its_equation():
    scores, weights = np.array([3.0, 1.0, -0.5]), np.array([0.01, 0.05, 0.94])
    x = toxicity.chance_decay(scores, weights)
    assert (weights * np.exp(x * scores)).sum() == pytest.approx(1.0) and x > 0.01
    assert toxicity.chance_decay(np.array([-1.0]), np.array([1.0])) == 50.0


def held_out_accuracy(spark, name, target, sf):
    got = QUERIES[name][0](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert got.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.5 as int)").isEmpty()
    return got.agg(F.avg((F.col("predicted") == F.col(target)).cast("double"))).first()[0]


def test_toxicity_held_out(spark):
    assert held_out_accuracy(spark, "op2_toxicity", "toxic", "/root/testdata/sf0.1") > 0.97


def test_quality_held_out(spark):
    assert held_out_accuracy(spark, "op6_quality", "quality", SF) > 0.97


@pytest.mark.parametrize("module,target", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, module, target):
    df = odd_rows(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(11)] + [(3, 1, "x"), (None, 1, "x"), (5, None, "x"), (99, 0, "x")], f"doc_id long, {target} int, text string")
    for known in (labels, labels.limit(0), labels.where(f"{target} = 1")):
        model = module.fit(df, known, fold(F.col("doc_id"), 3) != 1)
        got = module.scored(df, model)
        assert got.count() == df.count() and got.where("score is null or isnan(score) or score < 0 or score > 1").isEmpty()
        same = df.withColumn("s", module.score_of(F.col("text"), model)).where("doc_id = 8").join(got.select("doc_id", F.col("score").alias("g")), "doc_id")
        assert all(r["s"] == pytest.approx(r["g"]) for r in same.collect())
    assert module.scored(empty(spark), model).count() == 0


def test_labels_and_other_columns_are_no_inputs(spark):
    documents, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    train = fold(F.col("doc_id"), 3) != 1
    flipped = labels.withColumn("quality", F.when(train, F.col("quality")).otherwise(1 - F.col("quality")))
    plain = quality.scored(documents, quality.fit(documents, labels, train))
    other = documents.withColumns({"source": F.lit("x"), "lang": F.lit("y")})
    assert plain.exceptAll(quality.scored(other, quality.fit(other, flipped, train))).isEmpty()


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(40)]
    values = [rng.normal(size=8) for _ in rows]
    signs = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    x = np.zeros((40, 31))
    for k, (row, value) in enumerate(zip(rows, values)):
        x[k, row] = value
    x[:, 30] = 1
    w, bias = quality.dual_descent(rows, values, signs, np.ones(40))

    def loss(v):
        return 0.5 * v @ v + (np.maximum(0, 1 - signs * (x @ v)) ** 2).sum()

    best = np.zeros(31)
    for _ in range(20000):  # gradient descent on the primal
        slack = np.maximum(0, 1 - signs * (x @ best))
        best -= 0.002 * (best - 2 * x.T @ (signs * slack))
    assert loss(np.append(w[:30], bias)) <= loss(best) * 1.001


# --- tokens ------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    return bpe.Tokenizer(vocabulary)


@pytest.fixture(scope="module")
def speller(vocabulary):
    return bpe.Speller(vocabulary)


PARTS = ["a", "in", "the", "ing", "er", "th", "z", "!", "'", "'s", "é", "é", "日", "😀", "ß", " ", "\n", "0", "½", "ﬁ", "<|endoftext|>", "..", "<|startoftext|>", "İ", "Σ", "\x1c", "\x00", "\x7f", "​", "힣"]


@given(st.lists(st.sampled_from(PARTS), max_size=120).map("".join))
@settings(max_examples=300, deadline=None)
def test_ids_and_decoding_as_the_library(tokenizer, speller, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(tokenizer.encode(text), np.int32)
    assert got.tolist() == want
    assert speller.decode_tokens(pa.array(got)).decode() == library.decode(want, skip_special_tokens=False)


@given(st.text(alphabet="abeinorst", min_size=400, max_size=1500))
@settings(max_examples=25, deadline=None)
def test_stream_gives_the_same_in_bounded_memory(tokenizer, library, piece):
    merges = tokenizer.pieces.merges
    encoder, out, most = bpe.Encoder(merges), [], 0
    for symbol in piece[:-1]:
        out += encoder.feed(symbol)
        most = max(most, len(encoder.nodes) + len(encoder.tail))
    out += encoder.finish(piece[-1])
    assert out == library.encode(piece, add_special_tokens=False).ids and most <= 2 * (merges.lookahead + merges.longest) + 2


def test_long_pieces(tokenizer, library):
    for piece in ("a" * 5000, "ab" * 3000, "!" * 4000, "inin" * 999, "日本" * 800):
        assert np.frombuffer(tokenizer.encode(piece), np.int32).tolist() == library.encode(piece, add_special_tokens=False).ids


def test_text_decoding_joins_split_characters(tokenizer, speller):
    ids = np.frombuffer(tokenizer.encode("日本語 naïve 😀!"), np.int32).tolist()
    parts = list(bpe.decode_text(speller, ids))
    assert "".join(parts) == "日本語 naïve 😀 ! ".replace("😀 !", "😀!") and all("�" not in p for p in parts)
    stream = bpe.Utf8Stream()
    assert stream.feed("é".encode()[:1]) == "" and stream.feed("é".encode()[1:]) == "é" and stream.feed(b"\xe6\x97") + stream.finish() == "�"


def test_encode_and_decode_tables(spark, vocabulary, library):
    df = odd_rows(spark)
    encoded = bpe.encode(df, vocabulary)
    assert encoded.columns == ["doc_id", "text", "entries", "score", "ids"] and encoded.count() == df.count()
    for r in bpe.decode(encoded, vocabulary).collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(empty(spark), vocabulary), vocabulary).count() == 0
    both = bpe.encode(df, vocabulary, keep_text=False, decoded="score")
    assert both.columns == ["doc_id", "entries", "ids", "score"]
    apart = bpe.decode(encoded, vocabulary).select("doc_id", "entries", "ids", F.col("decoded").alias("score"))
    assert both.exceptAll(apart).isEmpty() and both.count() == df.count()
    words = bpe.decode(encoded.where("doc_id = 6"), vocabulary, words=True).first()["decoded"]
    assert words == "日本 語 "
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(nothing, vocabulary).first()["decoded"] == ""


def test_op3_digests(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op3_bpe"][0](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


# --- fingerprints ------------------------------------------------------------------------------
def test_op8_edits_and_likeness(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op8_order_minhash"][0](spark, SF).collect()}
    order = sorted(texts, reverse=True)
    prints = {}
    for k, i in enumerate(order):
        text, after = texts[i], order[(k + 1) % len(order)]
        half = len(text) // 2
        new = text[: len(text) - half] + texts[after][:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["next_id"]) == (len(text), hashlib.sha256(new.encode()).hexdigest(), after)
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 and prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1)
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.1 > 10 * np.mean([r["near_next"] for r in got.values()])


def brute_signature(words):
    """The same definition with dictionaries; the hash comes from Spark."""
    seen, kmers = Counter(), []
    for place, gram in enumerate(words):
        kmers.append((gram, seen[gram], place))
        seen[gram] += 1
    return kmers


def test_signature_follows_its_definition(spark):
    texts = ["the cat sat on the mat the cat sat on the mat", "one", "a b c d e f g h i j", "x " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(order_minhash.signature(F.col("t"))).collect()]
    for text, entries in zip(texts, got):
        words = text.split()
        grams = [tuple(words[max(0, i - 2) : i + 1]) for i in range(len(words))]
        unique = sorted(set(grams))
        h1 = dict(zip(unique, [r[0] >> 24 for r in spark.createDataFrame([(list(g),) for g in unique], "g array<string>").select(
            F.xxhash64(F.get("g", F.size("g") - 3), F.get("g", F.size("g") - 2), F.get("g", F.size("g") - 1))).collect()]))
        kmers = brute_signature([h1[g] for g in grams])
        h2 = [r[0] >> 24 for r in spark.createDataFrame([(h, int(o)) for h, o, _ in kmers], "h long, o int").select(F.xxhash64("h", "o")).collect()]
        bins = {}
        for h, (_, _, place) in zip(h2, kmers):
            bins.setdefault((h >> 34) & 63, []).append((h, place))
        pairs = {b: [h for h, _ in sorted(sorted(v)[:2], key=lambda x: x[1])] for b, v in bins.items()}
        rows = [(b, *(p + [None])[:2]) for b, p in pairs.items()]
        hashed = spark.createDataFrame(rows, "b int, x long, y long").select("b", F.pmod(F.xxhash64("x", "y"), F.lit(65536)).alias("p")).collect()
        assert sorted(entries) == sorted(r["b"] * 65536 + r["p"] for r in hashed)


def test_fingerprints_of_odd_rows(spark):
    for n in (0, 2):
        df = odd_rows(spark, n)
        got = order_minhash.edited(df)
        assert got.count() == df.count() and got.where("entries is null or edited is null or n_chars is null").isEmpty()
    assert order_minhash.edited(empty(spark)).count() == 0
    alone = order_minhash.edited(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert alone["edited"] == "abab" and alone["next_id"] == 5


def test_order_matters(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    swapped = [w for i in range(0, 400, 2) for w in (words[i + 1], words[i])]
    other = [f"v{i}" for i in rng.permutation(400)]
    df = spark.createDataFrame([(" ".join(words), " ".join(x)) for x in (words, moved, swapped, other)], "a string, b string")
    same, block, pairs, none = (r[0] for r in df.select(order_minhash.likeness(order_minhash.signature(F.col("a")), order_minhash.signature(F.col("b")))).collect())
    assert same == 1 and none == 0 and 0.2 < block < 0.9 and pairs < 0.05


# --- licenses ----------------------------------------------------------------------------------
def test_longest_increasing_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        seconds = rng.permutation(12).tolist()
        pairs = list(enumerate(seconds))
        subsets = ([seconds[i] for i in range(12) if mask >> i & 1] for mask in range(1 << 12))
        best = max(len(s) for s in subsets if s == sorted(s))
        got = license_align.increasing(pairs)
        assert len(got) == best and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))


@given(st.lists(st.sampled_from("abcdefg"), max_size=25), st.lists(st.sampled_from("abcdefg"), max_size=25))
@settings(max_examples=200, deadline=None)
def test_alignment_matches_equal_words_in_order(text, template):
    got = license_align.align(text, template)
    assert all(text[i] == template[j] for i, j in got) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))
    assert len(license_align.align(template, template)) == len(template)


def test_license_places(spark):
    mit = license_align.NOTICES["MIT-notice"]
    apache = license_align.NOTICES["Apache-2.0-header"]
    edited = mit.replace("free of charge", "at no cost").replace("merge,", "")
    rows = [(0, "prose here " * 50 + "Released under the MIT License. " + "more prose " * 50), (1, edited), (2, "x " * 3000 + apache + " y" * 3000 + " " + mit),
            (3, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (4, "the license of the version under the released prose"), (5, None), (6, ""), (None, "All rights reserved.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: [(x["name"], x["first"], x["coverage"]) for x in r["licenses"]] for r in license_align.scan_licenses(df).collect()}
    assert got[0] == [("MIT", 100, 1.0)] and [n for n, *_ in got[1]] == ["MIT-notice"] and 0.8 <= got[1][0][2] < 1
    assert {("Apache-2.0-header", 3000, 1.0), ("Apache-2.0", 3000, 1.0)} <= set(got[2]) and [n for n, *_ in got[2]].count("MIT-notice") == 1
    assert [(n, f) for n, f, _ in got[3]] == [("CC-BY-NC-4.0", 0), ("CC-BY-NC-4.0", 7)] and got[4] == got[5] == got[6] == []
    assert [n for n, *_ in got[None]] == ["All-rights-reserved"] and license_align.scan_licenses(empty(spark)).count() == 0


NEAR_MISSES = [
    ("Licensed under CC BY 4.0", ["CC-BY-4.0"]), ("Licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
    ("Licensed under CC BY-SA 3.0", ["CC-BY-SA-3.0"]), ("Licensed under CC BY 1.0", []), ("released under the BSD License", ["BSD"]), ("released under the 3-clause BSD license", ["BSD-3-Clause"]),
    ("released under the New BSD License", ["BSD-3-Clause"]), ("released under the BSD 2-Clause License", ["BSD-2-Clause"]), ("released under the MIT License", ["MIT"]),
    ("Released under the MIT-0 license", ["MIT-0"]), ("released under the Expat License", []), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]), ("This work is licensed under the GNU General Public License, version 4.", []),
    ("licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]), ("licensed under the GNU Lesser General Public License v2.1", ["LGPL-2.1"]),
    ("licensed under the GNU Affero General Public License v3.0", ["AGPL-3.0"]), ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 1.1", []), ("Licensed under the Mozilla Public License 2.0", ["MPL-2.0"]), ("Not all rights are reserved", []),
    ("All rights, as ever, reserved", []), ("All rights reserved", ["All-rights-reserved"]), ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
    ("SPDX-License-Identifier: GPL-3.0-only", ["GPL-3.0-only"]), ("SPDX-License-Identifier: MIT", ["MIT"]), ("SPDX-License-Identifier: Other-1.0", []),
    ("the MIT of this license was released", []), ("the software is available under the terms of the Boost Software License 1.0", ["BSL-1.0"]), ("under the terms of the ISC license", ["ISC"]),
    ("Creative Commons", []), ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
    ("licensed under a Creative Commons Attribution 4.0 International License", ["CC-BY-4.0"]), ("released under the Unlicense", ["Unlicense"]), ("distributed under CC0", ["CC0-1.0"]),
]


def test_statements_are_told_from_their_siblings():
    known = license_align.Catalogue(license_align.catalogue())
    names = lambda text: [name for _, _, name, _ in known.find(license_align.words_of(text))]
    for text, want in NEAR_MISSES:
        assert names(f"Some prose before it. {text} and some prose after it.") == want, text
    for name, text in license_align.NOTICES.items():
        assert name in names(text) and all(c == 1 for _, _, n, c in known.find(license_align.words_of(text)) if n == name)
        others = [n for n in names(text) if n != name and n in license_align.NOTICES]
        assert others == [], (name, others)
    three = license_align.NOTICES["GPL-3.0-notice"]
    assert names(three.replace("{3}", "2")) == ["GPL-2.0-notice"] and names(three.replace("{3}", "9")) == []
    assert names(license_align.NOTICES["BSD-3-Clause-text"].replace("copyright holder", "Regents of the University")) == ["BSD-3-Clause-text"]
    assert names(" ".join([license_align.NOTICES["ISC-notice"], license_align.NOTICES["MIT-text"]])) == ["ISC-notice", "MIT-text"]


def test_licenses_against_every_place(spark):
    """Each place of each text aligned with each statement, without passing any over."""
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    statements = [*license_align.NOTICES.items(), ("MIT", "Released under the MIT License"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0")]
    rng = np.random.default_rng(2)
    for name in ("MIT-notice", "GPL-2.0-notice", "MPL-2.0-notice"):  # with words lost and others put in
        words = [w for w in license_align.words_of(license_align.NOTICES[name]) if rng.random() > 0.05]
        texts.append("before " + " ".join(w if rng.random() > 0.05 else f"{w} extra" for w in words) + " after")
    known, total = license_align.Catalogue(statements), 0
    for text in texts:
        words, want = license_align.words_of(text), []
        for name, statement in statements:
            s, at = license_align.Statement(name, statement), 0
            while at < len(words):
                found = s.at(words, at) if words[at] in s.counts else None
                if found:
                    want.append((at, found[0], name, found[1] / len(s.words)))
                at = found[0] if found else at + 1
        got = known.find(words)
        assert set(got) <= set(want)
        for a, b, name, _ in set(want) - set(got):  # left out for another of the family or for a longer one around it
            assert any(x < b and a < y and n != name for x, y, n, _ in got)
        total += len(got)
    assert total > 5


def test_license_lines_of_the_documents(spark):
    """Against a search for the lines as plain text."""
    lines = ["licensed under the apache license, version 2.0", "released under the mit license", "gnu general public license, version 3", "cc by-nc 4.0", "all rights reserved"]
    texts = {r["doc_id"]: r["text"].lower() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_found"] > 0 for r in QUERIES["op9_license_align"][0](spark, SF).collect()}
    assert got == {i: any(line in t for line in lines) for i, t in texts.items()} and sum(got.values()) > 20


# --- scores ------------------------------------------------------------------------------------
def brute_scores(rows, order):
    """rows: (id, words). Stupid backoff with the document itself left out."""
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    all_ = [Counter(g for _, w in rows for g in grams(w, n)) for n in range(1, order + 1)]
    total, out = sum(all_[0].values()), []
    for _, w in rows:
        own = [Counter(grams(w, n)) for n in range(1, order + 1)]
        left = lambda g: all_[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        score = 0.0
        for i in range(len(w)):
            factor = 0.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    score += factor + math.log((left(g) or 0.5) / max(total - len(w), 1))
                elif left(g) > 0:
                    score += factor + math.log(left(g) / left(g[:-1]))
                    break
                factor += math.log(0.4)
        out.append(score)
    return out


@pytest.mark.parametrize("order,bytes_", [(1, 10**9), (2, 10**9), (3, 3000)])
def test_backoff_scores(spark, monkeypatch, order, bytes_):
    monkeypatch.setattr(backoff_lm, "BATCH_BYTES", bytes_)
    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(list("abcDEFgh"), rng.integers(0, 60))) for _ in range(60)] + ODD[:8] + ["only here", "a\tb\nc"]
    rows = [(i, [w for w in (t or "").encode().lower().split()]) for i, t in enumerate(texts)] + [(3, texts[3].encode().lower().split()), (None, [b"a", b"b"])]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (None, "a b", 3)], "doc_id long, text string, batch int")
    got = backoff_lm.score_documents(df, order=order).collect()
    want = sorted(zip([-1 if i is None else i for i, _ in rows], [len(w) for _, w in rows], brute_scores(rows, order)))
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["log_score"]) for r in got)
    assert [(a, b) for a, b, _ in have] == [(a, b) for a, b, _ in want] and np.allclose([h[2] for h in have], [w[2] for w in want])
    assert all((r["mean_log_score"] is None) == (r["n_tokens"] == 0) for r in got)


def test_no_documents_to_score(spark):
    assert backoff_lm.score_documents(empty(spark)).count() == 0
