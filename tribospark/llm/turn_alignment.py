"""Repair of conversations by aligning their turns to the grammar of roles, ``(s?(ua)+)?``.

The roles of a repaired conversation spell a string of the grammar. For each length there is one such
string (two with the leading system turn), so the cheapest repair is the best Wagner-Fischer alignment
of the turns to the strings of all feasible lengths. Lengths are tried by their least possible cost;
the best alignment so far bounds the diagonals of the next one (Ukkonen, 1985) and ends the search.
Of equally cheap repairs the one whose backtraced audit, the initials of its edits, is least stands.

Conversations are cut into blocks of ``BLOCK`` turns. One block is aligned as above. A longer
conversation needs the role before and after each block: each block is aligned from every role to
every role, these small cost tables are chained from the end (least cost still to come) and, once
the best continuation of each is known, from the start (role reached). Both chains join up to ``FAN``
neighbours at a time, level by level, so no task sees a conversation as a whole, and the repair is
the same as if it had been aligned in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribospark.operators.ordering import MAX_WINDOW_ROWS, RANGE_ROWS, number_rows
from tribospark.session import materialise

#: Turns of a block, and tables joined at once when blocks are chained.
BLOCK, FAN = 64, 1024
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
INF = 1 << 60
#: Roles that the grammar has seen last: none, system, user, assistant.
STATES = "-sua"
#: The least cost to come at the end of a conversation: it is empty or ends with the assistant.
END = (0, INF, INF, 0)
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\f\r"


# --- one block ---------------------------------------------------------------------------------
def grammar_string(entry: int, n: int, system: bool = False) -> str:
    """The n roles that follow state ``entry``; from the start, with or without the system turn."""
    pair = "au" if STATES[entry] == "u" else "ua"
    return (("s" if system else "") + pair * (n // 2 + 1))[:n]


def _left_by(entry: int, target: str) -> int:
    return STATES.index(target[-1]) if target else entry


def _table(kinds: str, must: list[bool], pay: list[int], target: str, budget: int, last: bool) -> list[list[int]] | None:
    """Least cost from (turns used, roles written) to the end, on diagonals that ``budget`` can reach.

    A turn may be inserted before any turn, and after the last one in the last block only, so that a
    conversation cut into blocks has each repair once.
    """
    n, m = len(kinds), len(target)
    most_inserts = (budget - DELETE * (n - m)) // (DELETE + INSERT)
    most_deletes = most_inserts + n - m
    if most_inserts < 0 or most_deletes < 0:
        return None
    table = [[INF] * (m + 1) for _ in range(n + 1)]
    row = table[n]
    row[m] = 0
    if last:
        for j in range(m - 1, max(0, n - most_deletes) - 1, -1):
            if target[j] == "s":
                break
            row[j] = INSERT + row[j + 1]
    for i in range(n - 1, -1, -1):
        row, below, kind, extra, gone = table[i], table[i + 1], kinds[i], pay[i], must[i]
        for j in range(min(m, i + most_inserts), max(0, i - most_deletes) - 1, -1):
            best = DELETE + below[j]
            if j < m:
                role = target[j]
                if not gone and (kind == role or role != "s"):
                    best = min(best, below[j + 1] + extra + (0 if kind == role else REROLE))
                if role != "s":
                    best = min(best, INSERT + row[j + 1])
            row[j] = best
    return table


def _edits(table: list[list[int]], kinds: str, must: list[bool], pay: list[int], target: str, last: bool) -> list[str]:
    """For each turn, its edits (inserts before it, its own, inserts after the last) as pairs of initial and role.

    Of equally cheap edits the one of the least initial is followed, which gives the least audit.
    """
    n, m, i, j, out, ahead = len(kinds), len(target), 0, 0, [], ""
    while i < n or j < m:
        cost, role = table[i][j], target[j] if j < m else ""
        if i < n and DELETE + table[i + 1][j] == cost:
            out.append(ahead + "D.")
            i, ahead = i + 1, ""
        elif role and role != "s" and (i < n or last) and INSERT + table[i][j + 1] == cost:
            ahead += "I" + role
            j += 1
        else:
            out.append(ahead + ("K" if kinds[i] == role else "R") + role)
            i, j, ahead = i + 1, j + 1, ""
    if ahead:
        out[-1] += ahead
    return out


def audit_of(edits: list[str]) -> str:
    return "".join(edits)[::2]


def align(kinds: str, faults: str, entry: int, to_come: tuple[int, ...], last: bool) -> tuple[int, list[str], int] | None:
    """(cost with what is to come, edits of each turn, state left) of the best repair of a block.

    ``kinds`` has s, u, a or another letter for each turn; ``faults`` b and d (must go), t (costs 5 if
    it stays) or a dot. None if nothing leads on from ``entry``.
    """
    n = len(kinds)
    must, pay = [f in "bd" for f in faults], [CUT_OFF if f == "t" else 0 for f in faults]
    gone = sum(must)
    limit = min(DELETE * n + INSERT * m + to_come[_left_by(entry, grammar_string(entry, m))] for m in range(3))
    opens = entry == 0 and any(k == "s" and not gone_ for k, gone_ in zip(kinds, must, strict=True))
    if opens:  # one system turn may stay
        limit = min(limit, DELETE * (n - 1) + CUT_OFF + to_come[STATES.index("s")])
    if limit >= INF:
        return None
    targets = []
    for system in (False, True) if opens else (False,):
        for m in range(1 if system else 0, n - gone + limit // INSERT + 1):
            target = grammar_string(entry, m, system)
            left = _left_by(entry, target)
            least = DELETE * max(gone, n - m) + INSERT * max(0, m - (n - gone)) + to_come[left]
            if least <= limit:
                targets.append((least, m, target, left))
    best = None
    for least, _, target, left in sorted(targets):
        if least > limit:
            break
        table = _table(kinds, must, pay, target, limit - to_come[left], last)
        if table is None or table[0][0] + to_come[left] > limit:
            continue
        cost = table[0][0] + to_come[left]
        edits = _edits(table, kinds, must, pay, target, last)
        if best is None or cost < limit or audit_of(edits) < audit_of(best[1]):
            best, limit = (cost, edits, left), cost
    return best


def costs_between(kinds: str, faults: str, last: bool) -> list[int]:
    """4 x 4 least costs of a block, by rows the state it is entered in, by columns the one it is left in."""
    ends = [tuple(0 if x == left else INF for x in range(4)) for left in range(4)]
    found = [align(kinds, faults, entry, end, last) for entry in range(4) for end in ends]
    return [best[0] if best else INF for best in found]


def cost_of(edits: list[str], faults: str) -> int:
    total = 0
    for edit, fault in zip(edits, faults, strict=True):
        initials = edit[::2]
        total += REROLE * initials.count("R") + DELETE * initials.count("D") + INSERT * initials.count("I")
        total += CUT_OFF * (fault == "t" and "D" not in initials)
    return total


# --- chains of blocks --------------------------------------------------------------------------
def _after(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Least sums of costs, by rows: matrix times vector or matrix where + is min and * is +."""
    return np.minimum(np.min(matrix[:, :, None] + vector[None, :, :], axis=1), INF)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def chain(matrices: DataFrame, start: tuple[int, ...], backward: bool, fan: int) -> DataFrame:
    """(conv_id, at, vector): the costs with which each block is met, coming from the end or the start.

    ``matrices`` holds (conv_id, at, matrix) with ``at`` from 0 and 4 x 4 costs by rows. Neighbours
    are multiplied ``fan`` at a time until one product is left for each conversation, then the
    vectors are handed down the same levels.
    """
    kind = matrices.schema["conv_id"].dataType.simpleString()

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([("at", "descending" if backward else "ascending")])

    def product(table: pa.Table) -> pa.Table:
        table = ordered(table)
        steps = np.array(table["matrix"].to_pylist(), np.int64).reshape(-1, 4, 4)
        whole = reduce(lambda done, step: _after(step, done), steps)
        at = table["at"][0].as_py() // fan
        return pa.table({"conv_id": table["conv_id"][:1], "at": pa.array([at], pa.int64()), "matrix": pa.array([whole.ravel().tolist()], pa.list_(pa.int64()))})

    def hand_down(table: pa.Table) -> pa.Table:
        table = ordered(table)
        vector, vectors = np.array(table["vector"][0].as_py(), np.int64).reshape(4, 1), []
        for step in table["matrix"].to_pylist():
            vectors.append(vector.ravel().tolist())
            vector = _after(np.array(step, np.int64).reshape(4, 4), vector)
        return pa.table({"conv_id": table["conv_id"], "at": table["at"], "vector": pa.array(vectors, pa.list_(pa.int64()))})

    levels, up = [matrices], F.floor(F.col("at") / fan).cast("bigint")
    while not levels[-1].where("at > 0").isEmpty():
        joined = levels[-1].groupBy("conv_id", up.alias("up")).applyInArrow(product, f"conv_id {kind}, at bigint, matrix array<bigint>")
        levels.append(materialise(joined))
    vectors = levels[-1].select("conv_id", "at", F.array(*[F.lit(x).cast("bigint") for x in start]).alias("vector"))
    for level in reversed(levels[:-1]):
        above = vectors.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_up"), "vector")
        met = level.withColumn("up", up).join(above, _same(F.col("conv_id"), F.col("_conv")) & (F.col("up") == F.col("_up")))
        met = met.groupBy("conv_id", "up").applyInArrow(hand_down, f"conv_id {kind}, at bigint, vector array<bigint>")
        vectors = materialise(met)
    return vectors


# --- conversations -----------------------------------------------------------------------------
def _numbered(turns: DataFrame, block: int, max_window_rows: int, range_rows: int) -> DataFrame:
    """Turns in order (by turn, nulls first, then role and text), with the place of each in its conversation."""
    turns = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    turns = turns.withColumn("_known", F.col("turn").isNotNull())
    placed = number_rows(turns, ["conv_id"], ["_known", "turn", "role", "text"], "pos", max_window_rows, range_rows)
    return materialise(placed.drop("_known").withColumn("block", F.floor(F.col("pos") / block).cast("bigint")))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, marks, firsts, ahead, more): what one block needs, of at most ``block`` turns.

    marks has two letters for each turn, its role and its fault by itself; firsts the places of turns
    that nothing equal goes before; ahead the role of the turn before the block; more is true if
    another block follows. Equal turns are found by one aggregate on a digest of their text, so
    copies are counted where they are, and only the first place travels on.
    """
    initial, end = F.substring("role", 1, 1), F.rtrim(F.col("text"), F.lit(WHITE))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    fault = F.when(end == "", "b").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "t").otherwise(".")
    marked = rows.select("conv_id", "block", "pos", F.concat(kind, fault).alias("mark"))
    nothing = F.lit(None)
    own = marked.select("conv_id", "block", F.struct("pos", "mark").alias("row"), nothing.cast("bigint").alias("first"), nothing.cast("string").alias("ahead"), nothing.cast("boolean").alias("more"))
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("pos").alias("first"))
    first = first.select("conv_id", F.floor(F.col("first") / block).cast("bigint").alias("block"), nothing.alias("row"), "first", nothing.alias("ahead"), nothing.alias("more"))
    before = marked.where(F.col("pos") % block == block - 1).select("conv_id", F.col("block") + 1, nothing, nothing, F.substring("mark", 1, 1), nothing)
    after = marked.where((F.col("pos") % block == 0) & (F.col("pos") > 0)).select("conv_id", F.col("block") - 1, nothing, nothing, nothing, F.lit(True))
    parts = own.union(first).union(before).union(after)
    blocks = parts.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list("row")).alias("rows"), F.collect_list("first").alias("firsts"), F.max("ahead").alias("ahead"), F.max("more").alias("more"),
    ).where(F.size("rows") > 0)
    marks = F.array_join(F.transform("rows", lambda row: row["mark"]), "")
    return blocks.select("conv_id", "block", marks.alias("marks"), "firsts", "ahead", F.coalesce("more", F.lit(False)).alias("more"))


def _solver(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Faults and illegal pairs of each block; edits where the conversation has one block, else costs from each state to each."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, faults, illegal, edits, matrices = [], [], [], [], []
            for block, marks, firsts, ahead, more in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                kind, fault, new = marks[::2], marks[1::2], {p - block * rows for p in firsts}
                fault = "".join(f if f == "b" or i in new else "d" for i, f in enumerate(fault))
                chars = (ahead or "") + kind
                kinds.append(kind)
                faults.append(fault)
                illegal.append(sum(chars[i : i + 2] not in LEGAL for i in range(len(chars) - 1)))
                alone = block == 0 and not more
                edits.append(align(kind, fault, 0, END, True)[1] if alone else None)
                matrices.append(None if alone else costs_between(kind, fault, not more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(5), pa.array(kinds, pa.string()), pa.array(faults, pa.string()),
                 pa.array(illegal, pa.int64()), pa.array(edits, pa.list_(pa.string())), pa.array(matrices, pa.list_(pa.int64()))],
                ["conv_id", "block", "more", "kinds", "faults", "illegal", "edits", "matrix"],
            )

    return solve


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best edits of a block from each state it may be entered in, and where they lead as a matrix of 0 and INF."""
    for batch in batches:
        choices, matrices = [], []
        for kinds, faults, more, vector in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
            best = [align(kinds, faults, entry, tuple(vector), not more) for entry in range(4)]
            choices.append([found[1] if found else None for found in best])
            # by rows the state left, by columns the state entered: it carries a vector forwards
            matrices.append([0 if found and found[2] == left else INF for left in range(4) for found in best])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(choices, pa.list_(pa.list_(pa.string()))), pa.array(matrices, pa.list_(pa.int64()))],
            ["conv_id", "at", "choices", "matrix"],
        )


def _long_edits(solved: DataFrame, fan: int) -> DataFrame:
    """(conv_id, block, edits) of conversations of several blocks."""
    kind = solved.schema["conv_id"].dataType.simpleString()
    blocks = solved.where(F.col("matrix").isNotNull()).withColumnRenamed("block", "at")
    to_come = chain(blocks.select("conv_id", "at", "matrix"), END, True, fan).withColumnsRenamed({"conv_id": "_conv", "at": "_at"})
    met = blocks.join(to_come, _same(F.col("conv_id"), F.col("_conv")) & (F.col("at") == F.col("_at")))
    chosen = met.select("conv_id", "at", "kinds", "faults", "more", "vector").mapInArrow(_choose, f"conv_id {kind}, at bigint, choices array<array<string>>, matrix array<bigint>")
    chosen = materialise(chosen)
    entered = chain(chosen.select("conv_id", "at", "matrix"), (0, INF, INF, INF), False, fan).withColumnsRenamed({"conv_id": "_conv", "at": "_at"})
    met = chosen.join(entered, _same(F.col("conv_id"), F.col("_conv")) & (F.col("at") == F.col("_at")))
    return met.select("conv_id", F.col("at").alias("block"), F.element_at("choices", F.array_position("vector", F.lit(0).cast("bigint")).cast("int")).alias("edits"))


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edits, faults = batch.column("edits"), batch.column("faults")
        cost = [cost_of(e, f) for e, f in zip(edits.to_pylist(), faults.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cost, pa.int64())], [*batch.schema.names, "cost"])


def repair(turns: DataFrame, block: int = BLOCK, fan: int = FAN, max_window_rows: int = MAX_WINDOW_ROWS, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(edits, summary) of the conversations in ``turns`` (conv_id, turn, role, text).

    edits: conv_id, pos, step, edit (D, I, K, R), turn, old_role, role, text, in the order (conv_id,
    pos, step); deleted turns are there with role null, inserted ones with an empty text and turn null.
    summary: conv_id, turns, gaps, blank, duplicate, truncated, illegal, cost.

    A null role or text counts as one space. Turns go by number, nulls first, equal ones by role and
    text. A role counts by its first letter; one that is not s, u or a (an empty one too) can't be kept.
    Null ids are one conversation. Other columns are ignored, and an empty table gives no rows.
    """
    rows = _numbered(turns, block, max_window_rows, range_rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    solved = _blocks(rows, block).mapInArrow(_solver(block), f"conv_id {kind}, block bigint, more boolean, kinds string, faults string, illegal bigint, edits array<string>, matrix array<bigint>")
    solved = materialise(solved)
    facts = solved.select("conv_id", "block", "faults", "illegal", "edits")
    if not solved.where(F.col("matrix").isNotNull()).isEmpty():
        found = _long_edits(solved, fan).withColumnsRenamed({"conv_id": "_conv", "block": "_block", "edits": "_edits"})
        long = facts.where(F.col("edits").isNull()).join(found, _same(F.col("conv_id"), F.col("_conv")) & (F.col("block") == F.col("_block")))
        facts = facts.where(F.col("edits").isNotNull()).unionByName(long.select("conv_id", "block", "faults", "illegal", F.col("_edits").alias("edits")))
    facts = materialise(facts.mapInArrow(_costs, f"conv_id {kind}, block bigint, faults string, illegal bigint, edits array<string>, cost bigint"))

    plan = facts.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.col("edits").alias("_edits"))
    met = rows.join(plan, _same(F.col("conv_id"), F.col("_conv")) & (F.col("block") == F.col("_block")))
    steps = F.regexp_extract_all(F.get("_edits", (F.col("pos") % block).cast("int")), F.lit("(..)"), 1)
    met = met.select("conv_id", "pos", "turn", "role", "text", F.posexplode(steps).alias("step", "_step"))
    edit, to = F.substring("_step", 1, 1), F.substring("_step", 2, 1)
    added, named = edit == "I", F.when(to == "u", ROLES["u"]).otherwise(ROLES["a"])
    edits = met.select(
        "conv_id", "pos", "step", edit.alias("edit"), F.when(~added, F.col("turn")).alias("turn"), F.when(~added, F.col("role")).alias("old_role"),
        F.when(edit == "K", F.col("role")).when(edit != "D", named).alias("role"), F.when(added, "").otherwise(F.col("text")).alias("text"),
    )

    count = lambda letter: F.sum(F.length("faults") - F.length(F.regexp_replace("faults", letter, ""))).cast("bigint")
    sums = facts.groupBy("conv_id").agg(count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    kinds_of_turn = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("_n"))
    gaps = kinds_of_turn.groupBy("conv_id").agg(F.sum("_n").alias("turns"), F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"))
    facts_of = ("blank", "duplicate", "truncated", "illegal", "cost")
    both = gaps.select("conv_id", "turns", "gaps", *[F.lit(None).cast("bigint").alias(c) for c in facts_of])
    both = both.unionByName(sums.select("conv_id", *[F.lit(None).cast("bigint").alias(c) for c in ("turns", "gaps")], *facts_of))
    return edits, both.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("turns", "gaps", *facts_of)])


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) from the edits of ``repair``.

    The lines ``role:text`` pass in order through one hash for each conversation, so a long one takes
    no more memory than its audit. SHA-256 can't be split: a conversation is the work of one task.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    ordered = edits.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step").select("conv_id", "edit", "role", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, state, lines, any_row = None, [], hashlib.sha256(), 0, False
        for batch in batches:
            done = []
            for conv, edit, role, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if any_row and conv != current:
                    done.append((current, "".join(audit), state.hexdigest()))
                    audit, state, lines = [], hashlib.sha256(), 0
                current, any_row = conv, True
                audit.append(edit)
                if edit != "D":
                    state.update((("\n" if lines else "") + f"{role}:{text}").encode())
                    lines += 1
            if done:
                yield _digest_rows(done, batch.schema.field(0).type)
        if any_row:
            yield _digest_rows([(current, "".join(audit), state.hexdigest())], batch.schema.field(0).type)

    return ordered.mapInArrow(digest, f"conv_id {kind}, audit string, repaired_sha256 string")


def _digest_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, audits, hashes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(audits, pa.string()), pa.array(hashes, pa.string())], ["conv_id", "audit", "repaired_sha256"])
