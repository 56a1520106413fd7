"""Mixing, tool calls and the pipeline against brute force."""

import itertools
import json
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tribospark.llm import mixing, tool_calls
from tribospark.llm.queries import CALL_SCHEMAS, conversation_calls
from tribospark.session import materialise

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- mixing ------------------------------------------------------------------------------------
def water_fill(sizes, share=1.5):
    """Deals by weight, caps, deals the excess again, until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, open_ = {}, set(names)
    while open_:
        level = (share * sum(sizes.values()) - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return fixed | {s: level * weight[s] for s in open_}
        fixed |= {s: 2 * sizes[s] for s in over}
        open_ -= over
    return fixed


def check_mix(rows, got):
    """rows: (doc_id, source, text)"""
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = water_fill(dict(sizes)), Counter()
    assert sorted(map(repr, ((r["doc_id"], r["source"], r["size"]) for r in got))) == sorted(map(repr, ((i, s, len(WORD.findall(t or ""))) for i, s, t in rows)))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["times"] <= 2
        taken[r["source"]] += r["size"] * r["times"]
    return {s: taken[s] - want[s] for s in sizes}


def test_mix_of_the_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in df.collect()]
    got = mixing.mix(df).collect()
    assert max(map(abs, check_mix(rows, got).values())) <= 1
    again = mixing.mix(df.repartition(13)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.parametrize("ranked", [20_000, 3])
def test_mix_of_odd_rows(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED", ranked)
    rows = [(i, "hot", "a b c") for i in range(400)] + [(1000 + i, s, "w " * (i + 1)) for i, s in enumerate(["é", "Z", "a", None, None, ""])]
    rows += [(2000, "none", ""), (2001, "none", None), (None, "hot", "x y"), (5, "hot", "a b c"), (5, "hot", "a b c"), (3000, "long", "w " * 30000)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, source string, text string, n int, rank int")
    got = mixing.mix(df).collect()
    off = check_mix(rows, got)
    assert abs(off["hot"]) <= 3 and all(r["times"] <= 2 for r in got)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect())[3000] == next(r["times"] for r in got if r["doc_id"] == 3000)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_knapsack_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(150):
        lengths = np.sort(rng.choice(np.arange(1, 30), 5, replace=False))
        counts, budget = rng.integers(0, 4, 5), int(rng.integers(0, 90))
        sums = {int(np.dot(c, lengths)) for c in itertools.product(*(range(n + 1) for n in counts))}
        taken = mixing.bounded_knapsack(lengths, counts, budget)
        assert (taken <= counts).all() and int(taken @ lengths) == max(s for s in sums if s <= budget)


def test_fitted_lengths_meet_the_budget():
    rng = np.random.default_rng(5)
    for scale in (1, 10**6):
        lengths = np.unique(np.concatenate([rng.integers(1, 900, 300), [20000, 1]]))
        counts = rng.integers(1, 50, len(lengths)) * scale
        total = int((lengths * counts).sum())
        for budget in (0, 1, 777, total // 3, total - 1, total):
            taken = mixing.fit_lengths(lengths, counts, budget)
            assert (taken >= 0).all() and (taken <= counts).all() and int((taken * lengths).sum()) == budget
    assert mixing.fit_lengths(np.array([0]), np.array([5]), 0).tolist() == [0]


# --- tool calls --------------------------------------------------------------------------------
SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
    "a": {"type": "integer", "minimum": 0, "maximum": 9}, "b": {"type": "array", "items": {"enum": ["x", "y"]}}, "c": {"type": "string", "minLength": 2}}}}


def linked(spark, calls, results):
    c = spark.createDataFrame([(*r, "clash") for r in calls], "conv_id long, call_id string, turn int, name string, arguments string, needs array<string>, content string")
    r = spark.createDataFrame([(*r, "clash") for r in results], "conv_id long, call_id string, turn int, content string, name string")
    return tool_calls.link(c, r, SCHEMAS)


def test_links_order_errors_and_json(spark):
    calls = [
        (1, "c3", 9, "add", '{"b":["x"],"a":1.0}', ["c2", "c1", "gone"]), (1, "c2", 5, "add", '{"a":10,"c":"z","d":1}', ["c1"]), (1, "c1", 7, "add", '{ "a" : 2 }', []),
        (2, "c1", 1, "sub", "{}", None), (2, "p", 1, "add", '{"a":1}', ["q"]), (2, "q", 2, "add", '{"a":1}', ["p"]), (2, "r", 3, "add", '{"a":1}', ["q"]), (2, "self", 3, "add", '{"a":1}', ["self"]),
        (3, "x", 2, "add", '{"a":1}', []), (3, "x", 1, "add", '{"a":3}', []), (3, "bad", 1, "add", "{oops", []), (3, "nan", 1, "add", '{"a":NaN}', []), (3, "two", 1, "add", '{"a":1,"a":2}', []),
        (3, "null", 1, "add", None, []), (None, "c", 1, "add", '{"a":1}', []), (4, None, 1, "add", '{"a":1}', []),
    ]
    results = [(1, "c1", 8, "é\n"), (1, "c1", 9, "late"), (1, "orphan", 3, "?"), (2, "c1", 4, None), (None, "c", 2, "lost")]
    got = {(r["conv_id"], r["call_id"], r["turn"]): r for r in linked(spark, calls, results).collect()}
    assert len(got) == 17
    one, two, three = (got[k] for k in ((1, "c1", 7), (1, "c2", 5), (1, "c3", 9)))
    assert (one["level"], two["level"], three["level"]) == (0, 1, 2) and one["answered"] and not two["answered"]
    assert one["line"] == '{"arguments":{"a":2},"id":"c1","name":"add","needs":[],"result":"é\\n"}' and one["errors"] == ["repeated result"]
    assert two["errors"] == [".a: out of range", ".c: length out of range", ".d: unknown"] and not two["valid"]
    assert three["valid"] and three["line"] == '{"arguments":{"a":1,"b":["x"]},"id":"c3","name":"add","needs":["c2","c1","gone"],"result":null}'
    assert got[1, "orphan", 3]["errors"] == ["no call"] and got[1, "orphan", 3]["line"] is None
    assert got[2, "c1", 1]["errors"] == ["unknown tool sub"] and got[2, "c1", 1]["answered"]
    assert all(got[2, k, t]["errors"] == ["circular"] and got[2, k, t]["level"] is None for k, t in (("p", 1), ("q", 2), ("r", 3), ("self", 3)))
    assert got[3, "x", 1]["errors"] == ["repeated call"] and json.loads(got[3, "x", 1]["line"])["arguments"] == {"a": 3}
    assert all(got[3, k, 1]["errors"] == ["arguments are no JSON"] for k in ("bad", "nan", "two", "null"))
    assert got[None, "c", 1]["errors"] == got[4, None, 1]["errors"] == got[None, "c", 2]["errors"] == ["no identifier"]
    assert linked(spark, [], []).count() == 0


def test_levels_are_longest_chains(spark, monkeypatch):
    rng = np.random.default_rng(6)
    calls, want = [], {}
    for conv in range(6):
        needs = {i: [int(j) for j in rng.choice(i, min(i, 2), replace=False)] if i else [] for i in range(12)}
        for i in range(12):
            want[conv, f"c{i}"] = max((want[conv, f"c{j}"] + 1 for j in needs[i]), default=0)
            calls.append((conv, f"c{i}", [f"c{j}" for j in needs[i]]))
    for i in range(300):  # a long chain, and one that branches now and then
        calls += [(7, f"c{i}", [f"c{i - 1}"] if i else []), (8, f"c{i}", [f"c{j}" for j in {i - 1, i - 2 if i % 60 == 0 else i - 1} if j >= 0])]
        want[7, f"c{i}"] = want[8, f"c{i}"] = i
    calls += [(9, "a", ["b"]), (9, "b", ["a"]), (9, "c", ["b", "d"]), (9, "d", ["nobody", None, "d2"]), (9, "d2", None), (9, "self", ["self"]), (9, "e", ["d2", "d2", "d"])]
    want |= {(9, "d2"): 0, (9, "d"): 1, (9, "e"): 2}
    schema = "conv_id int, call_id string, needs array<string>"
    df = spark.createDataFrame(calls, schema)
    written = []
    monkeypatch.setattr(tool_calls, "materialise", lambda frame, real=materialise: written.append(1) or real(frame))
    got = lambda frame, *bound: {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.levels(frame, *bound).collect()}
    assert got(df, 0) == want
    assert len(written) < 75  # two tables a round: far fewer rounds than the chains have calls
    assert got(df, 20) == want  # the chains by rounds, the others each by a task
    written.clear()
    ladder = [(10, f"c{i}", [f"c{j}" for j in (i - 1, i - 2) if j >= 0]) for i in range(300)]  # each waits for the two before it
    assert got(spark.createDataFrame(calls + ladder, schema)) == want | {(10, f"c{i}"): i for i in range(300)}
    assert len(written) == 1


def test_canonical_json():
    assert tool_calls.canonical({"b": [1.0, 2.5, True, None], "a": {"é": "€\n", "A": -0.0}}) == '{"a":{"A":0,"é":"€\\n"},"b":[1,2.5,true,null]}'
    assert tool_calls.canonical({"": 1, "😀": 2}) == '{"😀":2,"":1}'  # by UTF-16 units


def test_op4_conversations(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in turns.collect()}
    calls, results = conversation_calls(turns)
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link(calls, results, CALL_SCHEMAS).collect()}
    asked = {k for k, (role, _) in rows.items() if role != "assistant"}
    answers = {(c, t - 1) for (c, t), (role, _) in rows.items() if role == "assistant"}
    assert set(got) == {(c, f"c{t}") for c, t in asked | answers}
    for c, t in asked:
        r, text = got[c, f"c{t}"], rows[c, t][1]
        name = "configure" if rows[c, t][0] == "system" else "reply"
        chain = next(n for n in itertools.count() if (c, t - 2 * (n + 1)) not in asked)
        assert (r["answered"], r["level"], r["name"]) == ((c, t) in answers, chain, name)
        line = {"arguments": {"text": text, "turn": t, "words": len(text.split(" "))}, "id": f"c{t}", "name": name, "needs": [f"c{t - 2}"] if t >= 2 else [], "result": rows[c, t + 1][1] if (c, t) in answers else None}
        assert r["line"] == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r["valid"] == (1 <= len(text) <= (200 if name == "configure" else 300) and len(text.split(" ")) <= 60)


def test_op4_keeps_every_turn(spark):
    """A turn without a role, repeated turns and an answer to nothing each have their text in the result."""
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "reply"), (1, 2, None, "no role"), (1, 4, "user", "twice b"), (1, 4, "user", "twice a"),
            (1, 4, "user", "twice a"), (1, 5, "assistant", "two"), (1, 5, "assistant", "one"), (2, 0, "assistant", "to nobody"), (None, 3, "assistant", "lost")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = tool_calls.link(*conversation_calls(turns), CALL_SCHEMAS, every_row=True).collect()
    texts = Counter(t for r in got for v in [json.loads(r["line"])] for t in (v.get("arguments", {}).get("text"), v["result"]) if t is not None)
    assert texts == Counter(text for *_, text in rows)
    errors = sorted(e for r in got if (r["conv_id"], r["call_id"]) == (1, "c4") for e in r["errors"])
    assert errors == ["repeated call"] * 3 + ["repeated result"] * 2
    assert {r["line"] for r in got if r["conv_id"] == 2} == {'{"id":"c-1","result":"to nobody"}'}


# --- pipeline ----------------------------------------------------------------------------------
def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    label = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = materialise(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.where("text is null").isEmpty()
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert kept[-1] < kept[-2] and docs.count() == len(kept[-1]), name
    good, clean, single = kept[1:]
    assert all((label[i]["quality"] == 1) == (i in good) for i in label)
    assert not [i for i in good - clean if i in label and label[i]["toxic"] == 0]
    insults = {"trash", "scum", "idiot", "clown", "worthless", "moron", "pathetic", "loser", "stupid", "disgusting"}
    assert not [i for i in clean if len(insults & set(re.findall(r"\w+", texts[i].lower()))) > 2]
    sets, holders = {i: shingles(texts[i]) for i in clean}, defaultdict(list)
    for i in sorted(clean):
        for s in sets[i]:
            holders[s].append(i)
    best = {}
    for i in clean:
        common = Counter(j for s in sets[i] for j in holders[s] if j != i)
        best[i] = {j: n / (len(sets[i]) + len(sets[j]) - n) for j, n in common.items()}
    assert not [(i, j) for i in single for j, s in best[i].items() if j in single and s >= 0.85]  # none left
    assert all(max(best[i].values(), default=0) > 0.6 for i in clean - single)  # none taken for nothing
    lowest = {min([i, *(j for j, s in best[i].items() if s >= 0.99)]) for i in clean}
    assert single <= lowest  # the smallest id of equal texts stays
    mixed = materialise(corpus_pipeline.STAGES[3][1](spark, docs, SF))
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text))
    taken = Counter()
    for r in mixed.collect():
        assert r["text"] == texts[r["doc_id"]]
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(taken[s] - t) <= max(50, 0.01 * t) for s, t in water_fill(dict(sizes)).items())
    tokens = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    assert tokens.count() == mixed.count() and tokens.where("n_tokens <> size(ids)").isEmpty()


def test_run_is_its_stages_and_repeats_itself(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL))
    out = corpus_pipeline.run(spark, SMALL)
    assert out.exceptAll(docs).isEmpty() and docs.exceptAll(out).isEmpty() and out.count() > 100


def test_stages_take_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "fine words here", "en", "s", 15), (3, "fine words here", "en", "s", 15), (None, "no id", "en", None, 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.count() <= 2 * max(docs.count(), 0) and (stage is corpus_pipeline.tokens or out.columns == odd.columns)


def test_knapsack_keeps_one_number_a_sum():
    """Thousands of lengths against a budget: memory follows the budget, and the sum is the largest there is."""
    import tracemalloc

    import numpy as np

    from tribospark.llm import mixing

    lengths, counts = np.arange(8000, 0, -1) * 2, np.full(8000, 3)
    tracemalloc.start()
    taken = mixing.bounded_knapsack(lengths[lengths <= 8191], counts[lengths <= 8191], 8191)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int((taken * lengths[lengths <= 8191]).sum()) == 8190 and (taken <= 3).all() and peak < 8e6
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths, counts, budget = rng.choice(np.arange(1, 30), 5, replace=False), rng.integers(1, 4, 5), int(rng.integers(1, 80))
        sums = {0}
        for length, count in zip(lengths, counts):
            sums = {s + int(length) * c for s in sums for c in range(count + 1)}
        taken = mixing.bounded_knapsack(lengths, counts, budget)
        assert (taken <= counts).all() and int((taken * lengths).sum()) == max(s for s in sums if s <= budget)


def test_the_knapsack_is_bounded_where_one_document_is_longer_than_the_rest(monkeypatch):
    """A document too long for the budget leaves many words open; they are taken by length until the programme is small."""
    from tribospark.llm import mixing

    budgets, solve = [], mixing.bounded_knapsack
    monkeypatch.setattr(mixing, "bounded_knapsack", lambda lengths, counts, budget: (budgets.append(budget), solve(lengths, counts, budget))[1])
    for lengths, counts, budget, best in (
        ([3_000_000, 10, 7], [1, 1_000_000, 3], 2_900_001, 2_900_001),
        ([5_000_000, 4], [1, 10], 400_000, 40),  # all that is short enough
        ([900_000, 897_000, 300], [3, 1, 4], 899_000, 898_200),  # one of the long ones and what fits beside it
        ([900_000], [5], 4_499_999, 3_600_000),
        ([0, 5_000_000], [3, 1], 100_000, 0),
    ):
        taken = mixing.fit_lengths(np.array(lengths), np.array(counts), budget)
        assert (taken <= counts).all() and (taken >= 0).all() and taken @ np.array(lengths) == best
    assert max(budgets) <= mixing.SOLVED
