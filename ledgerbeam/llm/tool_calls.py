"""Chat formatting: links tool calls with their results, puts them in topological order, validates arguments, and writes canonical
JSON. Column functions and joins only.

A call has an id, the id of the call it comes after (or null), a tool and JSON arguments; a result has the id of its call. Equal
calls count as one; results are brought to a row for each id before they are hash-joined. The order is the number of calls before a call along `after`:
found by pointer doubling, so that a chain of n calls takes log n rounds of joins whatever its length. Arguments are checked
against (tool, field, type, required) rows: they must be an object, hold all required fields, hold no field that is not listed,
and each field must have its type (string, integer, number or boolean).

Each different call of an id has a row of its own, and equal ones count in `n_calls`; all calls of an id share its step, which follows the `after` of the
least of them (in tool, arguments and after). A row shows the least result of its id, and `n_results` tells how many there are; `link_results` has a row
for each different result, also of those without a call, so that no id gathers its results in one place. Calls without an id have a row without a
result or a step. A call after one that does not exist is first in its order. Calls in a circle have no step. Null arguments are not valid. Texts of any
length stay whole; empty tables give none. Columns other than those named pass by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Types of values as Spark names them, by the type of a field.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",)}


def steps(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(call_id, step) of (call_id, after): calls before it; null for calls in or behind a circle."""
    every = calls.select("call_id")
    parents = calls.join(every.withColumnRenamed("call_id", "after"), "after", "left_semi").select("call_id", "after")
    now = every.join(parents, "call_id", "left").select("call_id", F.col("after").alias("far"), F.when(F.col("after").isNull(), 0).otherwise(1).cast("long").alias("step"))
    now, total, k = scratch.cut(now, "steps-0"), every.count(), 0
    while 1 << k <= 2 * total and not now.where("far is not null").isEmpty():  # only circles are longer
        ahead = now.select(F.col("call_id").alias("far"), F.col("far").alias("next"), F.col("step").alias("more"))
        joined = now.join(ahead, "far", "left").select("call_id", F.col("next").alias("far"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"))
        k += 1
        now = scratch.cut(joined, f"steps-{k}")
        scratch.drop(f"steps-{k - 1}")
    return now.select("call_id", F.when(F.col("far").isNull(), F.col("step")).alias("step"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(call_id, after, tool, arguments, result, n_calls, n_results, step, valid, json) of calls (call_id, after, tool, arguments)
    and results (call_id, content)."""
    scratch = scratch or Scratch(calls.sparkSession, "tool-calls")
    different = scratch.cut(calls.groupBy("call_id", "after", "tool", "arguments").agg(F.count("*").alias("n_calls")), "calls")
    named = different.where("call_id is not null")
    one = scratch.cut(named.groupBy("call_id").agg(F.min(F.struct("tool", "arguments", "after")).alias("c")).select("call_id", "c.after"), "ids")
    answers = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("result"), F.count("*").alias("n_results"))
    linked = named.join(steps(one, scratch).join(answers, "call_id", "left"), "call_id")
    unnamed = different.where("call_id is null")  # by themselves: a join would send all of them to one task
    linked = linked.unionByName(unnamed, allowMissingColumns=True)
    rules = schemas.groupBy("tool").agg(F.collect_list(F.struct("field", "type", "required")).alias("_rules"))  # as many as a tool has fields
    linked = linked.join(rules, "tool", "left").withColumn("_value", F.expr("try_parse_json(arguments)"))
    types = F.expr("transform_values(from_json(arguments, 'map<string,variant>'), (k, v) -> regexp_extract(schema_of_variant(v), '^[A-Z]+', 0))")
    linked = linked.withColumn("_types", F.coalesce(types, F.expr("cast(map() as map<string,string>)")))
    held = F.forall("_rules", lambda r: F.when(F.map_contains_key("_types", r["field"]), _fits(r["type"], F.element_at("_types", r["field"]))).otherwise(~r["required"]))
    listed = F.forall(F.map_keys("_types"), lambda name: F.exists("_rules", lambda r: r["field"] == name))
    valid = F.col("_rules").isNotNull() & F.expr("schema_of_variant(_value) like 'OBJECT%'") & held & listed
    linked = linked.withColumn("valid", F.coalesce(valid, F.lit(False)))
    record = F.struct("after", F.col("_value").alias("arguments"), F.col("call_id").alias("id"), "result", "step", "tool", "valid")  # names in order
    linked = linked.withColumn("json", F.to_json(record, {"ignoreNullFields": "false"}))
    return linked.select("call_id", "after", "tool", "arguments", "result", "n_calls", F.coalesce("n_results", F.lit(0)).alias("n_results"), "step", "valid", "json")


def link_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(call_id, content, n_results, linked) of each different result; `linked` if a call has its id."""
    different = results.groupBy("call_id", "content").agg(F.count("*").alias("n_results"))
    ids = calls.where("call_id is not null").select("call_id").distinct().withColumn("linked", F.lit(True))
    named = different.where("call_id is not null").join(ids, "call_id", "left")
    return named.unionByName(different.where("call_id is null"), allowMissingColumns=True).withColumn("linked", F.coalesce("linked", F.lit(False)))


def _fits(kind: Column, found: Column) -> Column:
    fits = F.lit(False)
    for name, types in TYPES.items():
        fits = fits | ((kind == name) & found.isin(*types))
    return fits
