"""Near-duplicates of texts and vectors against all pairs."""

import numpy as np
import pytest
import xxhash

from tribospark.llm import bitslice, embedding_dedup, simhash
from tribospark.llm.components import components

WORDS = "the of and to in is that it for on as with was at by this from be are or an have not which you".split()


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def some_texts(n=60):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(WORDS, 80)) for _ in range(n // 3)]
    near = [" ".join(w if rng.random() > 0.01 else "changed" for w in t.split()) for t in base]
    copies = [base[0]] * (n // 3)
    odd = [None, "", " \t\n", "one", "two words", "É é É", "UPPER lower", "upper LOWER", "x" * 50000, "w " * 30000]
    return base + near + copies + odd


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    for width, radius in ((1, 3), (1, 0), (2, 5), (4, 40), (1, 64)):
        a = rng.integers(0, 2**63, (300, width)).astype(np.uint64)
        b = rng.integers(0, 2**63, (201, width)).astype(np.uint64)
        b[:100] = a[:100]
        for row in b[:100]:
            for _ in range(rng.integers(0, radius + 3)):
                row[rng.integers(width)] ^= np.uint64(1) << np.uint64(rng.integers(64))
        near = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2) <= radius
        i, j = bitslice.close_pairs(a, b, radius)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near)))) and len(i) == near.sum()


def test_forest_of_a_chain():
    a = np.arange(99)
    assert (bitslice.forest(100, a, a + 1) == 0).all() and bitslice.forest(3, np.zeros(0, int), np.zeros(0, int)).tolist() == [0, 1, 2]


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(50, i) for i in range(40)] + [(60, 61), (61, None)], [(3, 2), (2, 3), (9, 3)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long") if links else spark.createDataFrame([], "a long, b long")
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = roots({x for link in real for x in link}, real)
    assert {r["node"]: r["component"] for r in components(df).collect()} == want


def test_simhash_groups_equal_all_pairs(spark, monkeypatch):
    texts = some_texts()
    rows = [(i * 3, t, "clash", 1) for i, t in enumerate(texts)] + [(0, texts[0], "clash", 2), (None, "alone here at all", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, cell int")
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    ids = [r[0] for r in rows if r[0] is not None]
    links = [(a, b) for a in prints for b in prints if a is not None and b is not None and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = roots(ids, links)
    for block in (2048, 8):  # one block a cell, and many
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = simhash.groups(simhash.fingerprints(df), 3).select("doc_id", simhash.hex_print("fp").alias("f"), "component_id").collect()
        assert len(got) == len(rows)
        assert all(r["f"] == f"{prints[r['doc_id']]:016x}" for r in got)
        assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_pigeonhole_finds_every_close_pair(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(-(2**63), 2**63, 200)
    near = [int(v) ^ sum(1 << int(b) for b in rng.choice(63, 3, replace=False)) for v in values]
    df = spark.createDataFrame([([int(v)],) for v in [*values, *near]], "fp array<long>")
    for n in (10, 10**6, 10**9, 10**12):  # more fingerprints, other parts
        cells = simhash.pigeonhole_cells(df, 3, n)
        by = {}
        for r in cells.collect():
            by.setdefault(r["fp"][0], set()).add(r["cell"])
        assert all(by[int(a)] & by[b] for a, b in zip(values, near))


def test_simhash_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(simhash.fingerprints(df), 3).count() == 0
    assert simhash.one_of_each(df).columns == ["doc_id", "text"] and simhash.one_of_each(df).count() == 0


def test_one_of_each_keeps_one_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice(WORDS, 300)) for _ in range(12)]
    rows = [(i, t, "a") for i, t in enumerate(base)]
    rows += [(100 + i, t[: len(t) - 20] + " other end", "b") for i, t in enumerate(base[:6])]  # similarity over 0.9
    rows += [(200 + i, " ".join(rng.choice(WORDS, 150)) + t[: len(t) // 2], "c") for i, t in enumerate(base[6:])]  # about a third
    rows += [(0, base[0], "a"), (0, base[0], "a"), (None, base[1], "d"), (None, None, "d"), (300, "", "e"), (301, " ", "e")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, __keys string"))
    kept = sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None)
    assert kept == [*range(12), *range(200, 206), 300] and got.where("doc_id is null").count() == 2
    assert got.columns == ["doc_id", "text", "__keys"]


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    near = base[:20] + rng.normal(size=(20, 16)) * 0.07
    chain = [base[0]]
    for _ in range(6):
        chain.append(chain[-1] + rng.normal(size=16) * 0.05)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e-30] * 16, [3e38] * 16, [1.0, 0.0], [2.0, 0.0]]
    rows = [v.astype(np.float32).tolist() for v in [*base, *near, *chain, *[base[5]] * 9, base[7] * 1000]]
    return rows + odd


@pytest.mark.parametrize("settings", [{}, {"CELL_ROWS": 8, "BLOCK": 6}])
def test_embedding_links_equal_all_pairs(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    data = vectors()
    rows = [(i + 10, v, "clash") for i, v in enumerate(data)] + [(None, data[5], "clash")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")
    sound = {i: np.array(v, float) for i, (_, v, _) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in sound.items()}
    links = [(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    component = roots(range(len(rows)), links)
    members = {}
    for i, c in component.items():
        members.setdefault(c, []).append(rows[i][0])
    got = embedding_dedup.near_duplicates(df, 0.95, margin=0.5 if settings else embedding_dedup.MARGIN)
    assert got.columns[:4] == ["vec_id", "n_links", "component_id", "kept"] and got.count() == len(rows)
    for r in got.collect():
        i = next(k for k, row in enumerate(rows) if row[0] == r["vec_id"])
        want = min((m for m in members[component[i]] if m is not None), default=None)
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum(a == i for a, _ in links), want, r["vec_id"] is not None and want == r["vec_id"])


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(4, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(one).collect()] == [(4, 0, 4, True)]


def test_recall_on_the_given_vectors(spark):
    """Never a link too many, and at least 0.99 of them; 0.9 is what is asked for."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {r["vec_id"]: int(n) - 1 for r, n in zip(rows, (x @ x.T >= 0.95).sum(axis=1))}
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[k] <= n for k, n in want.items()) and sum(got.values()) >= 0.99 * sum(want.values())


# --- near-copies by the exact similarity -------------------------------------------------------
def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_all_pairs(texts, least=0.8):
    """Smallest id of each group whose links are the pairs of a five-word Jaccard similarity of ``least`` or more."""
    sets, holders, links = {i: five_words(t) for i, t in texts.items()}, {}, []
    for i in sorted(sets):
        common = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            holders[s].append(i)
        links += [(j, i) for j, n in common.items() if n / (len(sets[i]) + len(sets[j]) - n) >= least]
    empty_ids = sorted(i for i in sets if not sets[i])
    return set(roots(sets, links + [(empty_ids[0], i) for i in empty_ids[1:]]).values())


def test_near_copies_on_both_sides_of_the_threshold(spark):
    """Pairs just above, at and just below 0.8, short sets, and a copy whose second half is repeated."""
    texts, far = {}, 1000
    for k in range(60):  # n - 4 shingles; a changed last word ends one of them, so d changed at the end cost d
        words = [f"w{k}x{i}" for i in range(94)]  # 90 shingles
        d = (9, 10, 11, 12)[k % 4]  # (90 - d) / (90 + d): 0.818, 0.8, 0.782, 0.765
        texts[k], texts[far + k] = " ".join(words), " ".join(words[:-d] + [f"o{k}x{i}" for i in range(d)])
    for k in range(100, 140):
        words = [f"s{k}x{i}" for i in range(9)]  # 5 shingles, and 4 of them: 0.8
        texts[k], texts[far + k] = " ".join(words), " ".join(words[:-1])
    for k in range(140, 160):
        words = [f"r{k}x{i}" for i in range(200)]  # a half repeated six times has four new shingles
        texts[k], texts[far + k] = " ".join(words), " ".join(words[:100] + words[100:] * 6)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.one_of_each(df).select("doc_id").collect()}
    assert got == kept_by_all_pairs(texts) and len(got) == len(texts) - 30 - 40 - 20


def test_near_copies_of_the_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = kept_by_all_pairs(texts)
    assert len(want) < len(texts)
    for block in (2048, 2):  # in one block, and over many
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert {r["doc_id"] for r in simhash.one_of_each(docs).select("doc_id").collect()} == want
        docs = docs.where("doc_id < 100")
        want = kept_by_all_pairs({i: t for i, t in texts.items() if i < 100})
