"""Chat formatting: links tool calls with their results, orders them, checks their arguments and writes canonical JSON. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A tool's fields: kind, and whether it must be there. A kind is a name of KINDS, several joined by |, a list of the strings
#: that are allowed, or the fields of a nested object.
Schemas = Mapping[str, Mapping[str, tuple]]
#: What schema_of_variant calls values of a kind, at its start.
KINDS = {"STRING": ("STRING",), "NUMBER": ("BIGINT", "DECIMAL", "DOUBLE"), "INTEGER": ("BIGINT",), "BOOLEAN": ("BOOLEAN",), "NULL": ("VOID",), "ARRAY": ("ARRAY",), "OBJECT": ("OBJECT",)}

#: Digits of a number that stand before its point, or zeros after it, at most; others have an exponent.
PLAIN = 38
#: Characters from which on the parser may refuse JSON for its size alone: a string of so many, or a variant of over 128 MiB.
LARGE = 20_000_000


def _path(fields: Sequence[str]) -> str:
    """A variant path to nested fields, whatever characters their names hold but for double quotes and backslashes."""
    return "$" + "".join(f'["{f}"]' for f in fields)


def _field_errors(parsed: Column, wanted: Mapping[str, tuple], above: tuple[str, ...] = ()) -> Column:
    """Errors of an object's fields and of the objects in it: missing:f, type:f, unexpected:f; nested fields by their names joined by full stops."""
    none = F.array().cast("array<string>")
    own = F.to_json(F.try_variant_get(parsed, _path(above), "variant"))
    names = F.map_keys(F.from_json(own, "map<string,string>"))
    label = lambda f: ".".join((*above, f))
    found, below = [], []
    for field, (kind, needed) in sorted(wanted.items()):
        there = F.coalesce(F.array_contains(names, field), F.lit(False))
        held = F.schema_of_variant(F.try_variant_get(parsed, _path((*above, field)), "variant"))
        kinds = ["OBJECT"] if isinstance(kind, Mapping) else kind.split("|") if isinstance(kind, str) else ["STRING"]
        fits = F.coalesce(reduce(Column.__or__, (F.startswith(held, F.lit(start)) for k in kinds for start in KINDS[k])), F.lit(False))
        if not isinstance(kind, str | Mapping):
            fits = fits & F.coalesce(F.try_variant_get(parsed, _path((*above, field)), "string").isin(*kind), F.lit(False))
        found.append(F.when(there & ~fits, F.lit(f"type:{label(field)}")).when(F.lit(needed) & ~there, F.lit(f"missing:{label(field)}")))
        if isinstance(kind, Mapping):
            below.append(F.when(there & fits, _field_errors(parsed, kind, (*above, field))).otherwise(none))
    extra = F.transform(F.array_except(names, F.array(*map(F.lit, sorted(wanted))) if wanted else none), lambda f: F.concat(F.lit("unexpected:" + "".join(x + "." for x in above)), f))
    return F.concat(F.array_compact(F.array(*found)) if found else none, F.coalesce(extra, none), *below)


def too_large(arguments: Column) -> Column:
    """Whether text that is an object or array by its outline does not parse for its size alone."""
    outline = F.json_object_keys(arguments).isNotNull() | F.json_array_length(arguments).isNotNull()
    return F.coalesce((F.length(arguments) >= LARGE) & F.try_parse_json(arguments).isNull() & outline, F.lit(False))


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with a call's arguments (JSON text): malformed, too_large, not_an_object, unknown_tool, missing:f, type:f, unexpected:f."""
    parsed = F.try_parse_json(arguments)
    checks = F.array(F.lit("unknown_tool"))
    for tool, wanted in schemas.items():
        checks = F.when(name == tool, _field_errors(parsed, wanted)).otherwise(checks)
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    return F.array_sort(F.when(too_large(arguments), F.array(F.lit("too_large"))).when(parsed.isNull(), F.array(F.lit("malformed"))).when(~is_object, F.array(F.lit("not_an_object"))).otherwise(checks))


def plain_number(number: Column) -> Column:
    """A JSON number as all equal ones are written, by its digits alone, however many: 1e2, 100.0 and 100 give 100. Beyond PLAIN digits before or after the point as 1.5E40."""
    part = lambda group: F.regexp_extract(number, r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", group)
    exponent = F.when(part(4) == "", F.lit(0).cast("bigint")).otherwise(part(4).try_cast("bigint"))
    digits = F.ltrim(F.concat(part(2), part(3)), F.lit("0"))
    # the value is 0.digits times ten to the power of `point`
    point = F.length(part(2)) + exponent - (F.length(part(2)) + F.length(part(3)) - F.length(digits))
    digits = F.rtrim(digits, F.lit("0"))
    size = F.length(digits)
    whole = F.rpad(digits, point.cast("int"), "0")
    mixed = F.concat(F.substring(digits, F.lit(1), point.cast("int")), F.lit("."), F.substring(digits, point.cast("int") + 1, size))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point.cast("int")), digits)
    long = F.concat(F.substring(digits, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(""), F.lit("E"), (point - 1).cast("string"))
    shown = F.when((point >= size) & (point <= PLAIN), whole).when((point > 0) & (point < size), mixed).when((point <= 0) & (point > -PLAIN), small).otherwise(long)
    # exponents beyond 64 bits stay as they are
    return F.when(digits == "", F.lit("0")).when(exponent.isNull(), number).otherwise(F.concat(part(1), shown))


def canonical(arguments: Column) -> Column:
    """JSON text with keys in order at any depth, without blanks, its numbers as plain_number() writes them; null where it is malformed or too large for the parser.

    Numbers pass the parser as strings that begin with a control character, which then goes again, so that no digit is lost; where such a
    character begins a string of its own, it is doubled meanwhile. Quotes and backslashes that are escaped give way to characters that JSON text
    never holds, so that what lies between quotes can be told.
    """
    hidden = F.replace(F.replace(arguments, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    number = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
    marked = lambda x: F.when(x.rlike(number), F.concat(F.lit('"\\u0003'), plain_number(x), F.lit('"'))).otherwise(x)
    outside = lambda part: F.array_join(F.transform(F.split(part, r"(?<=[,:\[\]{}\s])|(?=[,\]}\s])"), marked), "")
    parts = F.transform(F.split(hidden, '"'), lambda part, i: F.when(i % 2 == 0, outside(part)).otherwise(F.replace(part, F.lit("\\u0003"), F.lit("\\u0003\\u0003"))))
    shown = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    back = F.regexp_replace(F.to_json(F.try_parse_json(shown)), r'"\\u0003([-0-9.E]+)"', "$1")
    return F.when(F.try_parse_json(arguments).isNotNull(), F.replace(back, F.lit("\\u0003\\u0003"), F.lit("\\u0003")))


def json_string(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def stages(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, stage and unmet (dependencies that name no call). Ordered by (stage, seq) a conversation's calls follow what they depend on.

    Where all dependencies point back, seq is such an order already and the stage is 0. Only conversations in which one points forward are
    peeled: the calls whose dependencies are all placed get the next stage; what is left in the end depends on itself and has stage null.
    Calls of one id in a conversation are one call, with the dependencies of all. Rounds are as many as the longest chain in those conversations.
    """
    nodes = calls.groupBy("conv_id", "call_id").agg(F.min("seq").alias("seq"))
    wanted = calls.select("conv_id", "call_id", F.explode("after").alias("dep")).where("dep IS NOT NULL").distinct()
    edges = written(wanted.join(nodes.select("conv_id", F.col("call_id").alias("dep"), F.col("seq").alias("dep_seq")), ["conv_id", "dep"], "left").join(nodes, ["conv_id", "call_id"]), "edges")
    unmet = edges.where("dep_seq IS NULL").groupBy("conv_id", "call_id").agg(F.count("*").alias("unmet"))
    edges = edges.where("dep_seq IS NOT NULL")
    disordered = edges.where("dep_seq > seq OR (dep_seq = seq AND dep >= call_id)").select("conv_id").distinct()
    pending = written(edges.join(disordered, "conv_id", "left_semi").select("conv_id", "call_id", "dep"), "pending")
    left = written(nodes.join(disordered, "conv_id", "left_semi").select("conv_id", "call_id"), "unplaced")
    placed: DataFrame | None = None
    number = 0
    while not left.isEmpty():
        ready = left.join(pending, ["conv_id", "call_id"], "left_anti")
        state = written(left.join(ready.withColumn("stage", F.lit(number)), ["conv_id", "call_id"], "left").select("conv_id", "call_id", "stage"), "stage")
        now = state.where("stage IS NOT NULL")
        if now.isEmpty():
            placed = state if placed is None else placed.unionByName(state)
            break
        placed = now if placed is None else placed.unionByName(now)
        pending = written(pending.join(now.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti").select("conv_id", "call_id", "dep"), "pending")
        left = state.where("stage IS NULL").select("conv_id", "call_id")
        number += 1
    nodes = nodes.join(unmet, ["conv_id", "call_id"], "left")
    if placed is None:
        return nodes.select("conv_id", "call_id", F.lit(0).alias("stage"), F.coalesce("unmet", F.lit(0)).alias("unmet"))
    nodes = nodes.join(placed.withColumn("peeled", F.lit(True)), ["conv_id", "call_id"], "left")
    return nodes.select("conv_id", "call_id", F.when(F.col("peeled"), F.col("stage")).otherwise(F.lit(0)).alias("stage"), F.coalesce("unmet", F.lit(0)).alias("unmet"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call, and one for each result id that no call has.

    calls: conv_id, call_id, seq, name, arguments (JSON text), after (ids of calls it depends on). results: conv_id, call_id, seq, content.
    Out: conv_id, call_id, seq, name, stage, n_results, errors (sorted, comma-joined), valid, json. Calls and results are hash-joined by
    (conv_id, call_id); the first result by seq counts. json has the keys in order, at any depth, without blanks, and equal numbers alike: the canonical form of
    the call with its result; numbers by their digits, never through a double. Objects and arrays that the parser refuses for their size alone (a string of over 20 million characters, 128 MiB in all) have the error too_large, are not held
    against the schema, and stand in json as a string, whole. Errors beside the arguments' are cycle, no_result, unmet_dependency and, for results alone, no_call.

    Null ids link with nothing and stay as rows of their own; null arguments are malformed; null or empty `after` is no
    dependency; calls that repeat stay as they are and each get the result. Other columns are not read.
    """
    first = results.groupBy("conv_id", "call_id").agg(F.min_by("content", "seq").alias("content"), F.count("*").alias("n_results"))
    calls = calls.select("conv_id", "call_id", "seq", "name", "arguments", "after")
    known = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    errors = argument_errors(F.col("name"), F.col("arguments"), schemas)
    linked = calls.withColumn("is_call", F.lit(True)).join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    linked = linked.join(stages(known), ["conv_id", "call_id"], "left")
    some = lambda when, what: F.when(when, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    is_call = F.coalesce("is_call", F.lit(False))
    found = F.when(
        is_call,
        F.concat(
            some(F.col("stage").isNull() & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(), "cycle"), errors, some(F.coalesce("n_results", F.lit(0)) == 0, "no_result"), some(F.coalesce("unmet", F.lit(0)) > 0, "unmet_dependency")
        ),
    ).otherwise(F.array(F.lit("no_call")))
    rest = F.to_json(F.struct("call_id", "conv_id", "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    held = F.coalesce(canonical(F.col("arguments")), F.when(too_large(F.col("arguments")), json_string(F.col("arguments"))), F.lit("null"))
    json = F.concat(F.lit('{"arguments":'), held, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    rows = linked.select("conv_id", "call_id", "seq", "name", "stage", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.array_join(F.array_sort(found), ",").alias("errors"), json.alias("json"))
    return rows.select("conv_id", "call_id", "seq", "name", "stage", "n_results", "errors", (F.col("errors") == "").alias("valid"), "json")
