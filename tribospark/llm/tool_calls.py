"""Chat formatting of tool calls: link calls with results, order them, validate arguments, write canonical JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribospark.session import materialise

_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; a float without fraction is written as an integer, as in RFC 8785."""
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else json.dumps(value)
    if isinstance(value, dict):  # by UTF-16 units, as that standard sorts
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def parse(text: str | None):
    """The JSON value, or ValueError: NaN, infinities and repeated keys are none."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name):
        raise ValueError(f"{name} is no JSON")

    value = json.loads(text or "", object_pairs_hook=unique, parse_constant=refuse)
    json.dumps(value, ensure_ascii=False).encode()  # lone surrogates can't be written
    return value


def problems(value, schema: dict, path: str = "") -> Iterator[str]:
    """What violates the schema: type, enum, required, properties, additionalProperties, items, and bounds."""
    kind, at = schema.get("type"), path or "."
    number = isinstance(value, int | float) and not isinstance(value, bool)
    fits = {"integer": number and math.isfinite(value) and value == int(value), "number": number}
    if kind and not fits.get(kind, kind in _TYPES and isinstance(value, _TYPES[kind])):
        yield f"{at}: not of type {kind}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at}: not allowed"
    if number and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        yield f"{at}: out of range"
    if isinstance(value, str | list) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        yield f"{at}: length out of range"
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        for name in sorted(set(schema.get("required", [])) - set(value)):
            yield f"{path}.{name}: missing"
        for name in sorted(value):
            if name in fields:
                yield from problems(value[name], fields[name], f"{path}.{name}")
            elif schema.get("additionalProperties") is False:
                yield f"{path}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            yield from problems(item, schema["items"], f"{path}[{k}]")


#: Calls of a conversation, and ten times that of their needs, up to which one task orders it as a whole. Changes no result.
GROUPED = 10_000


def order_calls(calls: list[tuple[str, list[str] | None]]) -> dict[str, int]:
    """The level of each call of one conversation that is on and behind no circle, in time linear in calls and needs."""
    ids = {call_id for call_id, _ in calls}
    waits = {call_id: {need for need in needs or () if need in ids} for call_id, needs in calls}
    behind: dict[str, list[str]] = {}
    for call_id, needs in waits.items():
        for need in needs:
            behind.setdefault(need, []).append(call_id)
    open_ = {call_id: len(needs) for call_id, needs in waits.items()}
    level = {call_id: 0 for call_id, n in open_.items() if not n}
    ready = list(level)
    while ready:
        done = ready.pop()
        for call_id in behind.get(done, ()):
            open_[call_id] -= 1
            level[call_id] = max(level.get(call_id, 0), level[done] + 1)
            if not open_[call_id]:
                ready.append(call_id)
    return {call_id: level[call_id] for call_id, n in open_.items() if not n}


def levels(calls: DataFrame, grouped: int = GROUPED) -> DataFrame:
    """(conv_id, call_id, level): the length of the longest chain of calls that a call waits for.

    ``calls`` has conv_id, call_id (each once), needs array<string>. Needs that no call of the conversation answers are
    left out. Calls on a circle, or behind one, get no row. Conversations of up to ``grouped`` calls are
    brought together and ordered by one task each; a longer one is ordered in rounds (``levels_by_rounds``).
    """
    links = F.coalesce(F.size("needs"), F.lit(0))
    sizes = calls.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.when(links > 0, links)).alias("links"))
    long = materialise(sizes.where((F.col("n") > grouped) | (F.col("links") > 10 * grouped)).select("conv_id"))
    all_short = long.isEmpty()
    short = calls if all_short else calls.join(long, "conv_id", "left_anti")
    lists = short.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "needs")).alias("calls"))
    kinds = dict(calls.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, call_kind = batch.column("calls").to_pylist(), batch.column("calls").type.value_type.field("call_id").type
            found = [order_calls([(c["call_id"], c["needs"]) for c in group]) for group in groups]
            own = np.repeat(np.arange(len(found)), [len(f) for f in found])
            names, values = ([x for f in found for x in part(f)] for part in (dict.keys, dict.values))
            out = [batch.column("conv_id").take(pa.array(own)), pa.array(names, call_kind), pa.array(values, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["conv_id", "call_id", "level"])

    placed = lists.mapInArrow(place, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, level int")
    return placed if all_short else placed.unionByName(levels_by_rounds(calls.join(long, "conv_id", "left_semi")))


def levels_by_rounds(calls: DataFrame) -> DataFrame:
    """The levels of conversations of any length, by joins.

    An open call has a row (need, dist, level) for each call it waits for: its own level is at least ``level``, and at least
    ``dist`` above that of the need. Each round settles the calls whose needs are all placed; then rows that wait for a
    call with one need only are moved on to that one. So chains are halved, and the rounds are about the logarithm of
    the longest chain, and one for each branching on it.
    """
    key = ["conv_id", "call_id"]
    named = calls.select("conv_id", F.col("call_id").alias("need"))
    wants = calls.select(*key, F.explode(F.array_distinct("needs")).alias("need")).where("need is not null")
    wants = wants.join(named, ["conv_id", "need"]).select(*key, "need", F.lit(1).alias("dist"), F.lit(0).alias("level"))
    open_ = materialise(wants)
    placed = materialise(calls.select(*key).join(open_.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0)))
    rounds = [placed]
    while not placed.isEmpty():
        done = placed.select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("at"))
        met = F.col("at").isNotNull()
        open_ = materialise(
            open_.join(done, ["conv_id", "need"], "left").select(
                *key, F.when(~met, F.col("need")).alias("need"), "dist",
                F.when(met, F.greatest("level", F.col("at") + F.col("dist"))).otherwise(F.col("level")).alias("level"),
            )
        )
        state = open_.groupBy(*key).agg(
            F.count("need").alias("open"), F.max("level").alias("level"), F.max("need").alias("via"), F.max(F.when(F.col("need").isNotNull(), F.col("dist"))).alias("via_dist")
        )
        state = materialise(state)
        placed = state.where("open = 0").select(*key, "level")
        rounds.append(placed)
        single = state.where("open = 1").select("conv_id", F.col("call_id").alias("need"), "via", "via_dist", F.col("level").alias("via_level"))
        rest = open_.join(placed.select(*key), key, "left_anti").join(single, ["conv_id", "need"], "left")
        moved = F.col("via").isNotNull()
        open_ = rest.select(
            *key, F.coalesce("via", "need").alias("need"), F.when(moved, F.col("dist") + F.col("via_dist")).otherwise(F.col("dist")).alias("dist"),
            F.when(moved, F.greatest("level", F.col("via_level") + F.col("dist"))).otherwise(F.col("level")).alias("level"),
        )
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def repeated(rows: DataFrame, fields: list[str], first: DataFrame, key: list[str]) -> DataFrame:
    """The rows of each identifier in ``first`` without the one that is there, repeats included.

    Equal rows are counted with partial sums and written out again from their number, so a hot identifier is no hot group.
    """
    kept = first.select(*key, F.struct(*fields).alias("kept"))
    counted = rows.groupBy(*key, *fields).agg(F.count("*").alias("times")).join(kept, key)
    times = F.col("times") - F.col("kept").eqNullSafe(F.struct(*fields)).cast("bigint")
    left = counted.withColumn("times", times).where("times > 0")
    return left.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*key, *fields)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], every_row: bool = False) -> DataFrame:
    """One row for each call, and for each result without a call: conv_id, call_id, turn, level, name, answered, valid, errors, line.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), needs array<string>. ``results``: conv_id, call_id,
    turn, content. Calls and results meet in a join on (conv_id, call_id). Of several calls, or results, of one
    identifier the first by turn counts, and the error "repeated call" or "repeated result" is added; with
    ``every_row`` each further one has a row of its own with that error, without level and link. Within a
    conversation (level, turn, call_id) is a topological order; level is null for circles. ``line`` is the canonical
    JSON of the call with its result (null if unanswered), and null if the arguments are no JSON or there is no call; with
    ``every_row`` it then is that of what there is (id, and name and arguments as text, or result). Rows with a null
    conv_id or call_id link with nothing and have the error "no identifier". Other columns are ignored.
    """
    key = ["conv_id", "call_id"]
    has_key = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select(*key, "turn", "name", "arguments", "needs")
    results = results.select(*key, "turn", "content")
    # the first of an identifier is found with partial sums, so a hot identifier is no hot group
    fields = F.struct("turn", "name", "arguments", "needs")
    first = calls.where(has_key).groupBy(*key).agg(F.min(fields).alias("c"), F.count("*").alias("n_calls"))
    first = materialise(first.select(*key, "c.*", "n_calls"))
    # the others of an identifier: all rows like the first but one, and all unlike it
    more_calls = repeated(calls.where(has_key), ["turn", "name", "arguments", "needs"], first.where("n_calls > 1"), key)
    answer = results.where(has_key).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    answer = materialise(answer)
    more_results = repeated(results.where(has_key), ["turn", "content"], answer.where("n_results > 1").select(*key, "r.*"), key)
    linked = first.join(answer, key, "full").join(levels(first), key, "left")
    called = F.lit(1).cast("bigint").alias("n_calls")
    loose = calls.where(~has_key).select("*", called, F.lit("no identifier").alias("error"))
    for part in (
        results.where(~has_key).select("*", F.lit("no identifier").alias("error")),
        *([more_calls.select("*", called, F.lit("repeated call").alias("error"))] if every_row else []),
        *([more_results.select("*", F.lit("repeated result").alias("error"))] if every_row else []),
    ):
        loose = loose.unionByName(part, allowMissingColumns=True)
    known = F.array_distinct(F.coalesce("needs", F.array().cast("array<string>")))
    both = linked.select(
        *key, F.coalesce("turn", "r.turn").alias("turn"), "level", "name", "arguments", known.alias("needs"),
        F.col("n_calls").isNotNull().alias("called"), F.col("r").isNotNull().alias("answered"), F.col("r.content").alias("content"),
        F.concat(
            F.when(F.col("n_calls").isNull(), F.array(F.lit("no call"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("n_calls") > 1, F.array(F.lit("repeated call"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("n_results") > 1, F.array(F.lit("repeated result"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("n_calls").isNotNull() & F.col("level").isNull(), F.array(F.lit("circular"))).otherwise(F.array().cast("array<string>")),
        ).alias("errors"),
    )
    lost = loose.select(
        *key, "turn", F.lit(None).cast("int").alias("level"), "name", "arguments", known.alias("needs"),
        F.col("n_calls").isNotNull().alias("called"), F.lit(False).alias("answered"), "content",
        F.array("error").alias("errors"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("call_id", "name", "arguments", "needs", "called", "answered", "content", "errors")}
            valid, errors, lines = [], [], []
            for call_id, name, arguments, needs, called, answered, content, wrong in zip(*columns.values()):
                line = None if called or not every_row else canonical({"id": call_id, "result": content})
                if called:
                    try:
                        value = parse(arguments)
                        wrong = wrong + ([f"unknown tool {name}"] if name not in schemas else list(problems(value, schemas[name])))
                        line = canonical({"arguments": value, "id": call_id, "name": name, "needs": needs, "result": content if answered else None})
                    except (ValueError, RecursionError):
                        wrong = wrong + ["arguments are no JSON"]
                        if every_row:
                            line = canonical({"arguments_text": arguments, "id": call_id, "name": name, "needs": needs, "result": content if answered else None})
                valid.append(bool(called) and not wrong)
                errors.append(wrong)
                lines.append(line)
            kept = [batch.column(n) for n in ("conv_id", "call_id", "turn", "level", "name", "answered")]
            made = [pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())]
            names = ["conv_id", "call_id", "turn", "level", "name", "answered", "valid", "errors", "line"]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    schema = ", ".join(f"{n} {kinds[n]}" for n in ("conv_id", "call_id", "turn", "level", "name", "answered"))
    return both.unionByName(lost).mapInArrow(write, f"{schema}, valid boolean, errors array<string>, line string")
