"""Turn alignment, host rules and ranked search against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tribospark.llm import host_rules, lexical_search, turn_alignment
from tribospark.llm.queries import damaged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- turn alignment ----------------------------------------------------------------------------
FOLLOWS = {"-": "su", "s": "u", "u": "a", "a": "u"}


def least_repair(kinds, faults):
    """(cost, audit) by trying every edit of every turn; each state keeps its least pair."""
    best = {"-": (0, "")}

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                for role in FOLLOWS[state].replace("s", ""):
                    found = (cost + 5, audit + "I")
                    states[role] = min(states.get(role, found), found)
        return states

    for kind, fault in zip(kinds, faults, strict=True):
        after = {}
        for state, (cost, audit) in inserted(best).items():
            moves = [(state, cost + 2, "D")]
            if fault not in "bd":
                for role in FOLLOWS[state]:
                    if role == kind or role != "s":
                        moves.append((role, cost + (role != kind) + 5 * (fault == "t"), "K" if role == kind else "R"))
            for role, total, letter in moves:
                found = (total, audit + letter)
                after[role] = min(after.get(role, found), found)
        best = after
    return min(pair for state, pair in inserted(best).items() if state in "-a")


turns_of = st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("...btd")), min_size=1, max_size=14)


@given(turns_of)
@settings(max_examples=400, deadline=None)
def test_alignment_is_the_least_repair(turns):
    kinds, faults = "".join(k for k, _ in turns), "".join(f for _, f in turns)
    cost, edits, left = turn_alignment.align(kinds, faults, 0, turn_alignment.END, True)
    audit = turn_alignment.audit_of(edits)
    assert (cost, audit) == least_repair(kinds, faults)
    assert turn_alignment.cost_of(edits, faults) == cost and len(edits) == len(kinds)
    said = "".join(k if e == "K" else role for step, k in zip(edits, kinds, strict=True) for e, role in zip(step[::2], step[1::2], strict=True) if e != "D")
    assert re.fullmatch(r"(s?(ua)+)?", said)


@given(turns_of, st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_blocks_chain_to_the_whole(turns, block):
    kinds, faults = "".join(k for k, _ in turns), "".join(f for _, f in turns)
    cuts = [(kinds[i : i + block], faults[i : i + block], i + block >= len(kinds)) for i in range(0, len(kinds), block)]
    vector, to_come = np.array(turn_alignment.END).reshape(4, 1), []
    for cut in reversed(cuts):
        to_come.insert(0, tuple(vector.ravel().tolist()))
        vector = turn_alignment._after(np.array(turn_alignment.costs_between(*cut)).reshape(4, 4), vector)
    entry, audit = 0, ""
    for (kind, fault, last), rest in zip(cuts, to_come, strict=True):
        _, edits, entry = turn_alignment.align(kind, fault, entry, rest, last)
        audit += turn_alignment.audit_of(edits)
    assert (vector[0, 0], audit) == least_repair(kinds, faults)


def plain_repair(rows, least=least_repair):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation's (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), ""
    for _, role, text in rows:
        end = "".join(WORD.findall(text))[-1:]
        faults += "b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else "."
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = least("".join(i if i and i in "sua" else "x" for i in initials), faults)
    lines, i = [], 0
    for letter in audit:
        state = lines[-1][0] if lines else "-"
        if letter != "I":
            _, role, text = rows[i]
            i += 1
        if letter == "K":
            lines.append((role[0], f"{role}:{text}"))
        elif letter != "D":
            to = "assistant" if state == "u" else "user"
            lines.append((to[0], f"{to}:" + ("" if letter == "I" else text)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, "\n".join(line for _, line in lines)


ODD_TURNS = [
    *[(1, t, r, x) for t, r, x in [(0, "system", "Be brief."), (1, "user", "Hi?"), (2, "assistant", "Yes.")]],
    *[(2, t, r, x) for t, r, x in [(None, "user", "first."), (0, None, "no role."), (0, "", "empty role."), (5, "tool", "x.")]],
    (3, None, None, None),
    (4, 9, "assistant", "word " * 30000),
    *[(None, t, "user", "same.") for t in range(5)],
    *[(5, 3, "user", "tie."), (5, 3, "assistant", "tie."), (5, 3, "user", "tie."), (5, 3, "user", " \t\n ")],
    *[(6, t, "uassssu"[t % 7 : t % 7 + 1], f"{t // 3} said{'.' if t % 5 else ''}" if t % 11 else "") for t in range(150)],
    *[(7, t, "user", "copy.") for t in range(90)],
]


@pytest.mark.parametrize(("block", "fan", "window"), [(64, 1024, 10**6), (4, 3, 10**6), (3, 2, 10), (1, 2, 10**6)])
def test_repair_of_odd_conversations(spark, block, fan, window):
    df = spark.createDataFrame([(*r, 1, "c") for r in ODD_TURNS], "conv_id long, turn long, role string, text string, pos int, block string")
    edits, summary = turn_alignment.repair(df, block, fan, window, 50)
    got = {r["conv_id"]: r for r in summary.collect()}
    digests = {r["conv_id"]: r for r in turn_alignment.digests(edits).collect()}
    groups = defaultdict(list)
    for conv, *row in ODD_TURNS:
        groups[conv].append(row)
    assert set(got) == set(groups) == set(digests)
    for conv, rows in groups.items():
        *numbers, audit, text = plain_repair(rows)
        assert [got[conv][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] == numbers
        assert (digests[conv]["audit"], digests[conv]["repaired_sha256"]) == (audit, hashlib.sha256(text.encode()).hexdigest())
        assert got[conv]["turns"] == len(rows)
    gone = edits.where("edit = 'D'").select("role").distinct().collect()
    assert [r["role"] for r in gone] == [None]


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    edits, summary = turn_alignment.repair(empty)
    assert edits.count() == summary.count() == turn_alignment.digests(edits).count() == 0


def test_damage_is_by_crc(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(12) for t in range(9)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got, want = Counter(map(tuple, damaged(df).collect())), Counter()
    import zlib

    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want[(c, t, "user" if fault == 4 else role, text)] += {0: 0, 3: 2}.get(fault, 1)
    assert got == +want


# --- host rules --------------------------------------------------------------------------------
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_repeated_words(words, window):
    words = [w.encode() for w in words]
    seen = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    want = {i + k for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for k in range(window)}
    assert host_rules.repeated_words(words, window) == len(want)


def plain_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    five = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if five[tuple(words[i : i + 5])] > 1 for k in range(5)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), len(lines)


HOST_TEXTS = [None, "", " \n\t\r\x0b\x0c ", "é 日本 😀 #*$%&|<>", "a\xa0b c", "one line\none line\n \n \none line ", "w " * 30000, "x" * 90000, "a b c d e f g h i j k l m", "\n".join(["a b c d e f g"] * 3)]


def test_host_rules_of_odd_rows(spark):
    rows = [(i, t, "mixed") for i, t in enumerate(HOST_TEXTS)] + [(None, "a b c d e f g h i j", None), (5, "twice", "mixed"), (5, "twice", "mixed")]
    rows += [(100 + i, f"good words of document {i} that stand here for a whole while", "mixed" if i < 40 else "good") for i in range(60)]
    rows += [(200 + i, "bad " * 3, "bad") for i in range(40)] + [(300, "one good text of a bad host has more than ten words here", "bad"), (301, "once", "single")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, n_words int, host string")
    got = host_rules.judge(df).collect()
    want = Counter()
    for doc, text, source in rows:
        counts = plain_counts(text)
        base = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want[(doc, *counts, base, source == "bad", not base and source != "bad")] += 1
    single = next(r for r in got if r["doc_id"] == 301)
    assert Counter((r["doc_id"], *[r[c] for c in host_rules.COUNTS], r["base_failed"], r["host_failed"] and r["doc_id"] != 301, r["kept"]) for r in got) == want
    assert not single["kept"]
    assert host_rules.judge(df.limit(0)).count() == 0


def test_prior_recovers_the_spread_of_rates():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 400, 3000)
    fails = rng.binomial(n, rng.beta(2, 6, len(n)))
    alpha, beta = host_rules.beta_prior(len(n), int(n.sum()), int(fails.sum()), int((n * n).sum()), float((fails * fails / n).sum()))
    assert alpha == pytest.approx(2, rel=0.1) and beta == pytest.approx(6, rel=0.1)
    same = rng.binomial(n, 0.2)  # no spread beyond chance: hosts are pulled to the common rate
    alpha, beta = host_rules.beta_prior(len(n), int(n.sum()), int(same.sum()), int((n * n).sum()), float((same * same / n).sum()))
    assert alpha + beta > 200 and alpha / (alpha + beta) == pytest.approx(0.2, abs=0.01)
    assert host_rules.beta_prior(0, 0, 0, 0, 0.0) == (0.0, host_rules.STRONGEST)


# --- ranked search -----------------------------------------------------------------------------
def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    tf = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in tf:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, rank + 1, None if null else d, -score) for rank, (score, null, d) in enumerate(sorted(found)[:k])]
    return out


def some_texts(rng, n):
    words = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    return [", ".join(rng.choice(words, rng.integers(1, 25), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize(("docs_a_shard", "block_terms"), [(10**6, 10**6), (23, 10**6), (40, 30)])
def test_search_equals_a_full_evaluation(spark, monkeypatch, docs_a_shard, block_terms):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(lexical_search, "PIECE", 50)
    rng = np.random.default_rng(11)
    texts = some_texts(rng, 300)
    docs = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[0]) for i in range(30)] + [(7, texts[7]), (7, texts[7]), (None, texts[3]), (None, None), (900, ""), (901, "\x00 -- ~"), (902, "w1 " * 40000), (903, "ÀÉ É é")]
    items = [(i, t) for i, t in enumerate(some_texts(rng, 12))] + [(3, texts[0]), (None, "w1 w59"), (50, None), (51, ""), (52, "unknown"), (53, "É À w0É W0é")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, score int").repartition(5)
    asked = spark.createDataFrame([(*q, "c") for q in items], "item_id long, text string, query string")
    got = lexical_search.search(df, asked, 10, block_terms=block_terms).collect()
    assert Counter(map(tuple, got)) == Counter(plain_search(docs, items, 10))
    assert lexical_search.search(df.limit(0), asked).count() == lexical_search.search(df, asked.limit(0)).count() == 0


def test_slots_are_limited():
    """A rare term settles the best; documents with common terms only get no slot, yet the result is the same."""
    n = 2000
    docs = np.concatenate([np.arange(60), np.arange(n)])
    terms_, tf = np.concatenate([np.zeros(60, np.int64), np.ones(n, np.int64)]), np.ones(n + 60, np.int64)
    shard = lexical_search.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 100), docs, terms_, tf)
    best = lexical_search.Best(50)
    assert shard.search(np.array([0, 1]), np.array([5000, 10]), best) == 60
    assert list(best.ids) == list(range(50)) and set(best.scores) == {5010 * int(shard.impact[0])}
    assert shard.search(np.array([0, 1]), np.array([10, 5000]), lexical_search.Best(50)) == n


def test_length_factor_passes_64_bits():
    got = lexical_search.length_factor(np.array([1, 10**9]), 10**9, 10**12)
    assert list(got) == [50 + 50 * 10**9 // 10**12, 50 + 50 * 10**18 // 10**12]
