"""Chat formatting: tool calls linked to their results, ordered, validated, written as canonical JSON.  DataFrame functions only.

Calls and results meet by a hash join on conversation and identifier.  Arguments are parsed as variants and checked against the tool's
schema: required parameters, types, ranges, enumerations, unknown names.  Every call is a record of its own, and so is every result without
a call: no conversation's texts are gathered in a row, however many of the rows it holds.

The topological order is a level: 0 for calls that depend on no call of their conversation, else one more than the highest level among those they depend on.
Where calls depend on each other in cycles, the dependencies of a cycle that go to later calls (by turn, then key; or to the call itself) are cut, and calls
that lose one are marked cyclic; all others, also those between two cycles, are kept.  A conversation of at most BOUND dependencies is ordered in one row, from
arrays of its call keys and turns alone; longer ones by rounds of joins, with equal results.  Records sorted by (conversation, level, turn, identifier) are the
conversation's order.

Canonical JSON has keys in byte order, no blanks, and numbers as the variant prints them.

Defined cases: null texts are empty; equal rows are one record with their number as `copies`; of several calls with one identifier in a conversation the
least (turn, name, digest of its arguments) is linked, the others stay with the error `duplicate`; of several results the least (turn, digest) is linked,
the others are orphans; a call without an identifier stays with the error `id`, one without a conversation with `conversation`, neither has a result;
arguments that aren't a JSON object (or repeat a key) give the error `json` and are kept as a string; an unknown tool gives `tool`;
a missing result is null; empty tables give no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, table

#: Tool: parameter: (type, required, least, most, values).
SCHEMAS: dict[str, dict[str, tuple]] = {
    "search": {"limit": ("integer", False, 1, 20, None), "query": ("string", True, None, None, None)},
    "summarize": {"max_words": ("integer", True, 10, None, None), "text": ("string", True, None, None, None)},
    "translate": {"target": ("string", True, None, None, ("de", "en", "es", "fr")), "text": ("string", True, None, None, None)},
}
KINDS = {"integer": ("BIGINT",), "string": ("STRING",), "boolean": ("BOOLEAN",)}
JSON = {"ignoreNullFields": "false"}
#: Dependencies of a conversation that is ordered in one row, at most; calls per whole number of a set.
BOUND, BITS = 2_048, 62


def errors(name: Column, args: Column, schemas: dict[str, dict[str, tuple]] = SCHEMAS) -> Column:
    """array<string> of what is wrong with a call: json, tool, missing:p, type:p, range:p, enum:p, unknown:p."""

    def of(parameter: str, spec: tuple) -> Column:
        kind, required, least, most, values = spec
        value = F.try_variant_get(args, f"$.{parameter}", "variant")
        found = F.schema_of_variant(value)
        bad = F.when(value.isNull() | (found == "VOID"), F.lit(f"missing:{parameter}") if required else F.lit(None))
        bad = bad.when(~F.when(F.lit(kind == "number"), found.rlike("^(BIGINT|DOUBLE|DECIMAL)")).otherwise(found.isin(*KINDS.get(kind, ()))), F.lit(f"type:{parameter}"))
        if least is not None or most is not None:
            number = F.try_variant_get(args, f"$.{parameter}", "double")
            bad = bad.when((number < least if least is not None else F.lit(False)) | (number > most if most is not None else F.lit(False)), F.lit(f"range:{parameter}"))
        if values is not None:
            bad = bad.when(~F.try_variant_get(args, f"$.{parameter}", "string").isin(*values), F.lit(f"enum:{parameter}"))
        return bad

    names = F.map_keys(F.try_variant_get(args, "$", "map<string,variant>"))
    out = F.when(args.isNull() | ~F.schema_of_variant(args).startswith("OBJECT"), F.array(F.lit("json")))
    for tool, parameters in sorted(schemas.items()):
        known = F.array(*[F.lit(p) for p in sorted(parameters)])
        unknown = F.transform(F.array_sort(F.array_except(names, known)), lambda n: F.concat(F.lit("unknown:"), n))
        out = out.when(name == tool, F.concat(F.array_compact(F.array(*[of(p, s) for p, s in sorted(parameters.items())])), F.coalesce(unknown, F.expr("cast(array() as array<string>)"))))
    return out.otherwise(F.array(F.lit("tool")))


def quoted(text: Column) -> Column:
    """text as a JSON string, or null."""
    return let(F.to_json(F.struct(text.alias("v")), JSON), lambda j: j.substr(F.lit(6), F.length(j) - 6))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple]] = SCHEMAS) -> DataFrame:
    """A row per distinct call of calls(conv_id, turn, call_id, name, arguments, depends) and per distinct result without a call.

    results(conv_id, turn, call_id, content).  Columns: kind (call or orphan), conv_id, call_id, turn, name, args (canonical JSON), depends, errors,
    result, copies, node (a key of the row), holder (whether others can name it as a dependency).
    """
    key = ["conv_id", "call_id"]
    call_tag = F.struct("turn", "name", F.md5(F.coalesce("arguments", F.lit(""))), F.to_json(F.struct("depends")))
    result_tag = F.struct("turn", F.md5(F.coalesce("content", F.lit(""))))

    def counted(df: DataFrame, tag: Column, columns: list[str]) -> DataFrame:
        """Equal rows with their number, counted map-side first; `first` marks the least of its key, never one with a null key."""
        least = df.groupBy(*key).agg(F.min(tag).alias("least"))
        rows = df.groupBy(*key, *columns).agg(F.count("*").alias("copies"))
        return rows.join(least, key, "left").withColumn("first", F.coalesce(tag == F.col("least"), F.lit(False))).drop("least")

    calls, results = counted(calls, call_tag, ["turn", "name", "arguments", "depends"]), counted(results, result_tag, ["turn", "content"])
    call = calls.select(*key, F.struct("turn", "name", "arguments", "depends", "copies").alias("c"), "first")
    result = results.select(*key, F.struct("turn", "content", "copies").alias("r"), "first")
    both = call.where("first").drop("first").join(result.where("first").drop("first"), key, "full").withColumn("holder", F.col("c").isNotNull())
    both = both.unionByName(call.where("not first").drop("first").withColumn("holder", F.lit(False)), allowMissingColumns=True)
    both = both.unionByName(result.where("not first").drop("first").withColumn("holder", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("args", F.try_parse_json("c.arguments")).withColumn("checked", errors(F.col("c.name"), F.col("args"), schemas))
    json = let(F.when(F.array_contains("checked", "json"), F.to_json(F.struct(F.col("c.arguments").alias("v")), JSON)).otherwise(F.to_json(F.struct(F.col("args").alias("v")), JSON)), lambda j: j.substr(F.lit(6), F.length(j) - 6))
    wrong = F.when(F.col("conv_id").isNull(), "conversation").when(F.col("call_id").isNull(), "id").when(~F.col("holder"), "duplicate")
    is_call = F.col("c").isNotNull()
    return both.select(
        F.when(is_call, "call").otherwise("orphan").alias("kind"), *key, F.when(is_call, F.col("c.turn")).otherwise(F.col("r.turn")).alias("turn"), F.col("c.name").alias("name"),
        F.when(is_call, json).alias("args"), F.coalesce("c.depends", F.expr("cast(array() as array<string>)")).alias("depends"),
        F.when(is_call, F.concat(F.array_compact(F.array(wrong)), F.col("checked"))).otherwise(F.array(F.lit("orphan"))).alias("errors"),
        F.col("r.content").alias("result"), F.coalesce("c.copies", "r.copies").alias("copies"), F.coalesce("r.copies", F.lit(0)).alias("result_copies"), "holder",
        F.md5(F.to_json(F.struct(*key, "c", F.when(~is_call, F.col("r"))), JSON)).alias("node"),
    )


def levels(linked: DataFrame, scratch: Scratch, bound: int = BOUND) -> DataFrame:
    """(node, level, cyclic) of every call of link()'s rows that depends on another of its conversation."""
    wants = linked.where("kind = 'call'").select("conv_id", "node", "turn", F.explode(F.array_distinct("depends")).alias("dep"))
    named = linked.where("holder").select("conv_id", F.col("call_id").alias("dep"), F.col("node").alias("on"), F.col("turn").alias("on_turn"))
    at, on_at = F.struct("turn", "node").alias("at"), F.struct(F.col("on_turn").alias("turn"), F.col("on").alias("node")).alias("on_at")
    edges = scratch.written(wants.join(named, ["conv_id", "dep"]).select("conv_id", "node", at, "on", on_at).distinct(), "edges")
    long = scratch.written(edges.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("conv_id"), "long")
    short = levels_in_rows(edges.join(long, "conv_id", "left_anti"))
    if long.isEmpty():
        return short
    return short.unionByName(levels_in_rounds(scratch.written(edges.join(long, "conv_id", "left_semi").drop("conv_id"), "rest"), scratch))


def settled(values: Column, n: Column, update: Callable[[Column, Column], Column]) -> Column:
    """The array values with each place i (from 1) set to update(array, i), up and down again and again, until nothing changes."""

    def at(acc: Column, i: Column) -> Column:
        return F.concat(F.slice(acc, F.lit(1), i - 1), F.array(update(acc, i)), F.slice(acc, i + 1, n))

    def sweep(acc: Column) -> Column:
        return F.aggregate(F.sequence(n, F.lit(1)), F.aggregate(F.sequence(F.lit(1), n), acc, at), at)

    def step(acc: Column, _: Column) -> Column:
        return F.when(acc.done, acc).otherwise(let(sweep(acc.v), lambda v: F.struct(v.alias("v"), (v == acc.v).alias("done"))))

    return F.aggregate(F.sequence(F.lit(0), n), F.struct(values.alias("v"), F.lit(False).alias("done")), step, lambda acc: acc.v)


def levels_in_rows(edges: DataFrame) -> DataFrame:
    """levels() of edges(conv_id, at, on_at), a conversation in a row: each has so few edges that its arrays are small.

    The waiting calls are numbered by turn and key.  Each gets a set (bits of whole numbers) of the calls it leads to; a dependency on a later call that leads
    back is cut.  Then each gets the highest level among its dependencies, and one more.
    """
    nodes = edges.groupBy("conv_id", "at").agg(F.collect_list("on_at").alias("ons")).groupBy("conv_id").agg(F.collect_list(F.struct("at", "ons")).alias("calls"))

    def sets(deps: Column, n: Column, places: Column) -> Column:
        merged = lambda r, j, more: F.transform(places, lambda w: r[w].bitwiseOR(more[w]).bitwiseOR(bit(j, w)))
        leads = lambda acc, i: F.aggregate(deps[i - 1], acc[i - 1], lambda r, j: F.when(j > 0, merged(r, j, acc[j - 1])).otherwise(r))
        return settled(F.transform(deps, lambda _: F.transform(places, lambda _: F.expr("0L"))), n, leads)

    def kept(deps: Column, n: Column, places: Column) -> Column:
        back = lambda leads, i, j: (j >= i) & ((j == i) | F.exists(places, lambda w: leads[j - 1][w].bitwiseAND(bit(i, w)) != 0))
        cut = let(sets(deps, n, places), lambda leads: F.transform(F.sequence(F.lit(1), n), lambda i: F.filter(deps[i - 1], lambda j: ~back(leads, i, j))))
        late = F.exists(F.sequence(F.lit(1), n), lambda i: F.exists(deps[i - 1], lambda j: j >= i))
        return F.when(late, cut).otherwise(deps)

    def found(keys: Column, deps: Column, n: Column, own: Column, level: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(keys[i]["node"].alias("node"), level[i].alias("level"), (F.size(own[i]) < F.size(deps[i])).alias("cyclic")))

    def ordered(keys: Column, deps: Column, n: Column) -> Column:
        highest = lambda own: lambda acc, i: F.aggregate(own[i - 1], F.lit(0), lambda top, j: F.greatest(top, 1 + F.when(j > 0, acc[j - 1]).otherwise(0)))
        of = lambda own: let(settled(F.transform(deps, lambda _: F.lit(0)), n, highest(own)), lambda level: found(keys, deps, n, own, level))
        places = F.sequence(F.lit(0), F.floor((n - 1) / BITS).cast("int"))
        return let(places, lambda places: let(kept(deps, n, places), of))

    # Each value is bound once (let): lambdas would otherwise make it anew for every element.
    numbered = lambda calls, keys: F.transform(calls, lambda c: F.transform(c.ons, lambda o: F.array_position(keys, o).cast("int")))  # noqa: E731, 0: waits for nothing
    by_number = lambda calls, keys: let(numbered(calls, keys), lambda deps: let(F.size(deps), lambda n: ordered(keys, deps, n)))
    whole = let(F.array_sort("calls"), lambda calls: let(F.transform(calls, lambda c: c["at"]), lambda keys: by_number(calls, keys)))
    return nodes.select(F.inline(whole))


def bit(j: Column, w: Column) -> Column:
    """The w-th whole number of a set that holds j (from 1) alone."""
    return F.when(w == F.floor((j - 1) / BITS), F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2), F.pmod(j - 1, F.lit(BITS))).cast("long")


def levels_in_rounds(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """levels() of edges(node, at, on, on_at) by rounds of joins, for conversations too long for a row; as many rounds as the longest chain has calls."""
    late = scratch.written(cycle_edges(edges, scratch).where("on_at >= at").select("node", "on"), "late")
    pending = scratch.written(edges.join(late, ["node", "on"], "left_anti").select("node", "on"), "pending")
    calls = edges.select("node").distinct().join(late.select("node").distinct().withColumn("cyclic", F.lit(True)), "node", "left")
    path, level, n = scratch.folder("released"), 0, pending.count()
    while n:
        level += 1
        waiting = pending.select("node").distinct()
        left = scratch.written(pending.join(waiting.withColumnRenamed("node", "on"), "on", "left_semi"), "left")
        waiting.join(left.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(level)).write.mode("append").parquet(path)
        scratch.drop(pending)
        pending, n = left, left.count()
    released = scratch.spark.read.schema("node string, level int").parquet(path) if level else pending.select("node", F.lit(0).alias("level"))
    return calls.join(released, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def cycle_edges(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges whose two ends lie on a common cycle: ends are trimmed, then strongly connected parts found, colour by colour.

    A node's colour is the greatest key from which a chain of dependencies leads to it.  The nodes of a colour that lead back to the key of that name are one
    strongly connected part; they go, and the rest is coloured anew.
    """

    def rounds(df: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Column) -> DataFrame:
        df, before = scratch.written(df, "round"), None
        while (now := df.agg(measure).first()[0]) != before:
            before, last = now, df
            df = scratch.written(step(df), "round")
            scratch.drop(last)
        return df

    def ends(df: DataFrame) -> DataFrame:
        return df.join(df.select(F.col("on").alias("node")).distinct(), "node", "left_semi").join(df.select(F.col("node").alias("on")).distinct(), "on", "left_semi").select(*df.columns)

    path, left, some = scratch.folder("parts"), rounds(edges, ends, F.count("*")), False
    while not left.isEmpty():
        some = True
        own = left.select("node").union(left.select("on")).distinct().withColumn("colour", F.col("node"))

        def paint(c: DataFrame, left: DataFrame = left) -> DataFrame:
            return left.join(c, "node").select(F.col("on").alias("node"), "colour").union(c.select("node", "colour")).groupBy("node").agg(F.max("colour").alias("colour"))

        colours = rounds(own, paint, F.bit_xor(F.xxhash64("node", "colour")))

        def back(part: DataFrame, left: DataFrame = left, colours: DataFrame = colours) -> DataFrame:
            more = left.join(part.select(F.col("node").alias("on"), "colour"), "on").select("node", "colour")
            return more.join(colours, ["node", "colour"], "left_semi").union(part.select("node", "colour")).distinct()

        part = rounds(colours.where("node = colour"), back, F.count("*"))
        part.write.mode("append").parquet(path)
        rest = left.join(part.select("node"), "node", "left_anti").join(part.select(F.col("node").alias("on")), "on", "left_anti").select(*edges.columns)
        left = rounds(rest, ends, F.count("*"))
    if not some:
        return edges.limit(0)
    parts = scratch.spark.read.schema("node string, colour string").parquet(path)
    ours, theirs = parts.withColumnRenamed("colour", "part"), parts.select(F.col("node").alias("on"), F.col("colour").alias("part"))
    return edges.join(ours, "node").join(theirs, ["on", "part"]).select(*edges.columns)


def records(linked: DataFrame, scratch: Scratch) -> DataFrame:
    """link()'s rows with their level and canonical JSON, in order."""
    linked = scratch.written(linked, "linked")
    placed = linked.join(levels(linked, scratch), "node", "left").withColumns({"level": F.coalesce("level", F.lit(0)), "cyclic": F.coalesce("cyclic", F.lit(False))})
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce("args", F.lit("null")), F.lit(',"conversation":'), quoted(F.col("conv_id")), F.lit(',"errors":['), F.array_join(F.transform("errors", quoted), ","),
        F.lit('],"id":'), quoted(F.col("call_id")), F.lit(',"level":'), F.col("level"), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), quoted(F.col("result")),
        F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"),
    )
    made = placed.select("conv_id", "level", "turn", "call_id", "kind", F.col("result").isNotNull().alias("has_result"), F.size("errors").alias("n_errors"), "cyclic", "copies", "result_copies", record.alias("record"))
    return made.orderBy("conv_id", "level", "turn", "call_id", "record")


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations, by rule: each assistant turn is a call (its tool by turn), the user turn after it the result.

    A call of turn 5 to 7 modulo 8 depends on that two turns before, one of turn 1 modulo 8 on that two turns after.  Limits, targets and
    missing parameters vary with the text's length, so that some calls break their schema.  A null conversation stays null.
    """
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    conv, turn = F.col("conv_id").cast("string"), F.coalesce(F.col("turn"), F.lit(-1)).cast("long")
    name_of = lambda t: F.concat(conv, F.lit("-"), t.cast("string"))
    tool = F.element_at(F.array(*map(F.lit, sorted(SCHEMAS))), (F.pmod(F.floor(turn / 2), F.lit(3)) + 1).cast("int"))
    target = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr", "xx"))), n % 5 + 1)
    args = F.when(tool == "search", F.to_json(F.struct((n % 25).alias("limit"), text.alias("query"))))
    args = args.when(tool == "summarize", F.to_json(F.struct((n % 30).alias("max_words"), F.when(n % 7 > 0, text).alias("text")))).otherwise(F.to_json(F.struct(target.alias("target"), text.alias("text"))))
    late, soon = F.pmod(turn, F.lit(8)) == 1, F.pmod(turn, F.lit(8)) >= 5
    depends = F.when(late, F.array(name_of(turn + 2))).when(soon, F.array(name_of(turn - 2))).otherwise(F.expr("cast(array() as array<string>)"))
    calls = conversations.where("role = 'assistant'").select(conv.alias("conv_id"), turn.alias("turn"), name_of(turn).alias("call_id"), tool.alias("name"), args.alias("arguments"), depends.alias("depends"))
    results = conversations.where("role = 'user' and turn > 0").select(conv.alias("conv_id"), turn.alias("turn"), name_of(turn - 1).alias("call_id"), text.alias("content"))
    return calls, results


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: one row per distinct call, and per distinct result without a call."""
    calls, results = derived(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return records(link(calls, results), Scratch(spark, "tool-calls"))


ORACLE = """
WITH t AS (SELECT conv_id::VARCHAR AS conv_id, coalesce(turn, -1) AS turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
said AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, ['search', 'summarize', 'translate'][1 + (floor(turn / 2)::BIGINT % 3 + 3) % 3] AS name, text, n, count(*) AS copies FROM t WHERE role = 'assistant' GROUP BY ALL),
checked AS (SELECT conv_id, turn, id, name, copies,
  CASE name WHEN 'search' THEN '{"limit":' || (n % 25) || ',"query":' || to_json(text) || '}'
            WHEN 'summarize' THEN '{"max_words":' || (n % 30) || CASE WHEN n % 7 > 0 THEN ',"text":' || to_json(text) ELSE '' END || '}'
            ELSE '{"target":"' || ['de', 'en', 'es', 'fr', 'xx'][1 + n % 5] || '","text":' || to_json(text) || '}' END AS arguments,
  CASE name WHEN 'search' THEN CASE WHEN n % 25 BETWEEN 1 AND 20 THEN [] ELSE ['range:limit'] END
            WHEN 'summarize' THEN list_concat(CASE WHEN n % 30 >= 10 THEN [] ELSE ['range:max_words'] END, CASE WHEN n % 7 > 0 THEN [] ELSE ['missing:text'] END)
            ELSE CASE WHEN n % 5 < 4 THEN [] ELSE ['enum:target'] END END AS wrong FROM said),
calls AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, id ORDER BY md5(arguments)) = 1 AS holder FROM checked),
answers AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS id, text, count(*) AS copies FROM t WHERE role = 'user' AND turn > 0 GROUP BY ALL),
results AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, md5(text)) = 1 AS first FROM answers),
holders AS (SELECT conv_id, turn FROM calls WHERE holder),
fifth AS (SELECT conv_id, turn, turn % 8 = 5 AND EXISTS (SELECT 1 FROM holders o WHERE o.conv_id = h.conv_id AND o.turn = h.turn - 2) AS waits FROM holders h),
level AS (SELECT c.*, CASE turn % 8
  WHEN 1 THEN EXISTS (SELECT 1 FROM holders o WHERE o.conv_id = c.conv_id AND o.turn = c.turn + 2)::INT
  WHEN 5 THEN EXISTS (SELECT 1 FROM holders o WHERE o.conv_id = c.conv_id AND o.turn = c.turn - 2)::INT
  WHEN 6 THEN EXISTS (SELECT 1 FROM holders o WHERE o.conv_id = c.conv_id AND o.turn = c.turn - 2)::INT
  WHEN 7 THEN coalesce((SELECT 1 + waits::INT FROM fifth o WHERE o.conv_id = c.conv_id AND o.turn = c.turn - 2), 0)
  ELSE 0 END AS level FROM calls c),
rows_ AS (
  SELECT 'call' AS kind, c.conv_id, c.turn, c.id, c.name, c.arguments, list_concat(CASE WHEN c.conv_id IS NULL THEN ['conversation'] WHEN NOT holder THEN ['duplicate'] ELSE [] END, c.wrong) AS errors,
    r.text AS result, c.copies, coalesce(r.copies, 0) AS result_copies, level
  FROM level c LEFT JOIN results r ON c.holder AND r.first AND r.conv_id = c.conv_id AND r.id = c.id
  UNION ALL SELECT 'orphan', r.conv_id, r.turn, r.id, NULL, 'null', ['orphan'], r.text, r.copies, r.copies, 0 FROM results r
  WHERE NOT (first AND EXISTS (SELECT 1 FROM calls c WHERE c.holder AND c.conv_id = r.conv_id AND c.id = r.id)))
SELECT conv_id, level, turn, id AS call_id, kind, result IS NOT NULL AS has_result, len(errors)::INT AS n_errors, false AS cyclic, copies, result_copies,
  '{"arguments":' || arguments || ',"conversation":' || coalesce('"' || conv_id || '"', 'null') || ',"errors":[' || coalesce(list_aggregate(list_transform(errors, lambda x: '"' || x || '"'), 'string_agg', ','), '')
  || '],"id":' || coalesce('"' || id || '"', 'null') || ',"level":' || level || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"turn":' || turn || '}' AS record
FROM rows_
"""
