"""Chat formatting: links tool calls with their results and writes canonical JSON.

A message of role `assistant` whose text is a JSON object with `tool_calls` makes
calls: objects with id, name, arguments and, if they use other calls' results,
`after`, a list of ids. A message of role `tool` with `tool_call_id` and `content` is a
result. Calls and results are joined by conversation and id, so a conversation of
any length is spread over tasks; nothing collects one.

Order: a call's place is its turn and a hop. It stands behind all calls that it names:
its turn is the latest of its own and theirs, however far back, and its hop the number
of steps from the call that has that turn. Chains are followed by pointer doubling, so
rounds grow with the logarithm of a chain and with the depth of calls that name
several. Calls in a cycle or behind one are `cycle` and keep their own turn.

Defined cases: a null, empty or malformed text, other roles and other JSON make no
call and no result; of calls with one id in a conversation the first counts (by turn,
place, name, arguments, `after`; of equal rows one), the others are `repeated`; of
results the first by turn and content counts; a result without call is `orphan`, a
call without result `unanswered`; ids named in `after` that no call has are an error
of the call; a null conversation id is a conversation of its own; an empty table
gives an empty table.
"""

from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.llm import common

KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def _messages(df, conv, turn, role, text):
    body = F.when(F.trim(F.col(text)).startswith("{"), F.try_parse_json(F.trim(F.col(text))))
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), body.alias("body"))


def calls(messages: DataFrame) -> DataFrame:
    """conv, turn, place in the message, id, name, arguments, after, repeated."""
    some = messages.filter("role = 'assistant' and body is not null").select("conv", "turn", F.posexplode(F.try_variant_get("body", "$.tool_calls", "array<variant>")).alias("place", "call"))
    rows = some.select("conv", "turn", "place", F.try_variant_get("call", "$.id", "string").alias("id"), F.try_variant_get("call", "$.name", "string").alias("name"),
                       F.try_variant_get("call", "$.arguments", "variant").alias("arguments"), F.try_variant_get("call", "$.after", "array<string>").alias("after"))
    return rows.filter("id is not null")


def results(messages: DataFrame) -> DataFrame:
    some = messages.filter("role = 'tool' and body is not null")
    return some.select("conv", "turn", F.try_variant_get("body", "$.tool_call_id", "string").alias("id"), F.try_variant_get("body", "$.content", "variant").alias("content")).filter("id is not null")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.id") == F.col(f"{b}.id"))


def numbered(called: DataFrame) -> DataFrame:
    """Adds first, true for one call of each conversation and id: the least by turn, place
    in the message, name, arguments and `after`, and of equal rows one. Equal rows and
    ids are counted and compared in aggregates, so a hot id is not collected."""
    order = ["turn", "place", "name", "arguments", "after"]
    rows = called.withColumn("arguments", F.to_json("arguments")).groupBy("conv", "id", *order).agg(F.count("*").alias("copies"))
    least = rows.groupBy("conv", "id").agg(F.min(F.struct(*order)).alias("least"))
    both = rows.alias("r").join(least.alias("l"), _same("r", "l")).select("r.*", F.struct(*(f"r.{c}" for c in order)).eqNullSafe(F.col("least")).alias("least"))
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("conv", "id", "turn", "place", "name", F.try_parse_json("arguments").alias("arguments"), "after", (F.col("least") & (F.col("copy") == 1)).alias("first"))


def _later(at: Column, hops: Column) -> Column:
    return F.struct(at["turn"].alias("turn"), (at["hop"] + hops).alias("hop"))


def _to(a: str, b: str) -> Column:
    """Same conversation, and the node that `a` points to is `b`."""
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.ptr") == F.col(f"{b}.id"))


def _chains(single: DataFrame) -> DataFrame:
    """Nodes with one predecessor, by pointer doubling: conv, id, ptr, c, k. A node's place
    is the later of c and the place of ptr with k more hops; ptr has no or several
    predecessors, or it is still such a node when the nodes stand in or behind a ring."""
    now = common.staged(single)
    size = now.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    for _ in range(size.bit_length()):
        step = now.alias("n").join(now.alias("p"), _to("n", "p"), "left")
        moved = F.col("p.id").isNotNull()
        now = common.staged(step.select(
            "n.conv", "n.id", F.when(moved, F.col("p.ptr")).otherwise(F.col("n.ptr")).alias("ptr"),
            F.when(moved, F.greatest("n.c", _later(F.col("p.c"), F.col("n.k")))).otherwise(F.col("n.c")).alias("c"),
            (F.col("n.k") + F.coalesce("p.k", F.lit(0).cast("long"))).alias("k")))
    return now


def places(called: DataFrame) -> DataFrame:
    """conv, id, at struct<turn, hop>, cycle: an order in which a call stands behind all
    calls that it names. called: conv, id, turn, after (one row per id).

    Calls that name one other form chains, which pointer doubling shortens to one step in
    as many rounds as the length of the longest has binary digits. What is left are calls
    that name several: in each round those are settled whose predecessors all are. The
    rounds end when one settles nothing; the rest stands in or behind a cycle, and keeps
    its own turn. No conversation has a part in another's result."""
    at = F.struct(F.col("turn").alias("turn"), F.lit(0).cast("long").alias("hop"))
    nodes = common.staged(called.select("conv", "id", at.alias("at"), F.array_distinct("after").alias("after")))
    edges = nodes.select("conv", "id", F.explode("after").alias("ptr")).alias("e").join(nodes.alias("p"), _to("e", "p")).select("e.conv", "e.id", "e.ptr")
    edges = common.staged(edges)
    if edges.isEmpty():
        return nodes.select("conv", "id", "at", F.lit(False).alias("cycle"))
    degree = edges.groupBy("conv", "id").agg(F.count("*").alias("n"), F.min("ptr").alias("ptr"))
    kinds = common.staged(nodes.alias("v").join(degree.alias("d"), _same("v", "d"), "left").select("v.conv", "v.id", "v.at", F.coalesce("n", F.lit(0)).alias("n"), "ptr"))
    chains = _chains(kinds.filter("n = 1").select("conv", "id", "ptr", F.col("at").alias("c"), F.lit(1).cast("long").alias("k")))
    settled = kinds.filter("n = 0").select("conv", "id", "at")
    several = kinds.filter("n > 1").select("conv", "id", "at")
    # edges into calls that name several, from the end of the chain they come out of
    into = edges.alias("e").join(several.alias("s"), _same("e", "s"), "left_semi")
    into = into.alias("e").join(chains.alias("h"), _to("e", "h"), "left").select(
        "e.conv", "e.id", F.coalesce("h.ptr", "e.ptr").alias("ptr"), F.col("h.c").alias("c"), F.coalesce("h.k", F.lit(0).cast("long")).alias("k"))
    waiting = common.staged(into)
    found = settled
    while not waiting.isEmpty():
        known = waiting.alias("e").join(found.alias("p"), _to("e", "p"), "left")
        behind = known.select("e.conv", "e.id", F.col("p.id").isNotNull().alias("settled"), _later(F.greatest("e.c", _later(F.col("p.at"), F.col("e.k"))), F.lit(1)).alias("behind"))
        ready = behind.groupBy("conv", "id").agg(F.min("settled").alias("settled"), F.max("behind").alias("behind")).filter("settled")
        new = common.staged(ready.alias("r").join(several.alias("s"), _same("r", "s")).select("r.conv", "r.id", F.greatest("s.at", "r.behind").alias("at")))
        if new.isEmpty():
            break
        # the literal keeps a projection over what was checkpointed, whose known facts name other columns
        found = common.staged(found.select("conv", "id", "at", F.lit(0).alias("new")).union(new.withColumn("new", F.lit(1)))).drop("new")
        waiting = common.staged(waiting.alias("e").join(new.alias("s"), _same("e", "s"), "left_anti"))
    ends = chains.alias("h").join(found.alias("p"), _to("h", "p")).select("h.conv", "h.id", F.greatest("h.c", _later(F.col("p.at"), F.col("h.k"))).alias("at"))
    done = found.withColumn("end", F.lit(0)).union(ends.withColumn("end", F.lit(1)))
    return nodes.alias("v").join(done.alias("d"), _same("v", "d"), "left").select("v.conv", "v.id", F.coalesce("d.at", "v.at").alias("at"), F.col("d.id").isNull().alias("cycle"))


def errors(name: Column, arguments: Column, tools: dict) -> Column:
    """What a call's arguments lack. tools: name -> {argument: (kind, required)}."""
    given = F.try_variant_get(arguments, "$", "map<string,variant>")
    found = []
    for tool, schema in sorted(tools.items()):
        checks = [F.when(given.isNull(), F.lit("arguments are no object"))]
        for arg, (kind, required) in sorted(schema.items()):
            value = F.element_at(given, arg)
            if required:
                checks.append(F.when(given.isNotNull() & value.isNull(), F.lit(f"{arg} is missing")))
            checks.append(F.when(value.isNotNull() & ~F.schema_of_variant(value).rlike(f"^{KINDS[kind]}$"), F.lit(f"{arg} is no {kind}")))
        known = F.array(*(F.lit(a) for a in sorted(schema))) if schema else F.expr("cast(array() as array<string>)")
        more = F.transform(F.array_sort(F.array_except(F.coalesce(F.map_keys(given), F.expr("cast(array() as array<string>)")), known)), lambda a: F.concat(a, F.lit(" is unknown")))
        found.append(F.when(name == tool, F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), more)))
    return F.coalesce(*found, F.array(F.lit("unknown tool")))


def link(df: DataFrame, tools: dict, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per call and per result without one: conversation, order_turn, order_hop,
    turn, call_index, call_id, name, status, errors, json."""
    messages = _messages(df, conv, turn, role, text)
    called = common.staged(numbered(calls(messages)).withColumn("repeated", ~F.col("first")))
    answered = common.staged(results(messages))
    one = called.filter("first")
    ordered = places(one.select("conv", "id", "turn", F.coalesce("after", F.expr("cast(array() as array<string>)")).alias("after")))
    content = F.struct("turn", F.to_json(F.struct("content")).alias("content"))
    answers = answered.groupBy("conv", "id").agg(F.min(content).alias("answer"), F.count("*").alias("answers"))
    # ids in `after` that no call has
    named = one.select("conv", F.col("id").alias("call"), F.explode("after").alias("id"))
    missing = named.alias("n").join(one.alias("c"), _same("n", "c"), "left_anti").groupBy("conv", F.col("call").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("after names "), F.col("id")))).alias("missing"))

    rows = called.alias("c").join(ordered.alias("o"), _same("c", "o"), "left").select("c.*", "o.at", "o.cycle")
    rows = rows.alias("c").join(missing.alias("m"), _same("c", "m"), "left").select("c.*", "m.missing")
    rows = rows.alias("c").join(answers.alias("a"), _same("c", "a"), "full").select(
        F.coalesce("c.conv", "a.conv").alias("conv"), F.coalesce("c.id", "a.id").alias("id"), "c.turn", "c.place", "c.name", "c.arguments", "c.after", "c.repeated", "c.at", "c.cycle", "c.missing", "a.answer", "a.answers")
    orphan = F.col("repeated").isNull()
    status = F.when(orphan, "orphan").when(F.col("repeated"), "repeated").when(F.col("cycle"), "cycle").when(F.col("answer").isNull(), "unanswered").otherwise("linked")
    nothing = F.expr("cast(array() as array<string>)")
    problems = F.when(orphan, nothing).otherwise(F.concat(errors(F.col("name"), F.col("arguments"), tools), F.coalesce("missing", nothing), F.when(F.col("answers") > 1, F.array(F.lit("more than one result"))).otherwise(nothing)))
    result = F.when(~F.coalesce("repeated", F.lit(False)), F.try_parse_json(F.col("answer.content")))
    body = F.struct(F.col("after"), F.col("arguments"), F.col("id"), F.col("name"), F.try_variant_get(result, "$.content", "variant").alias("result"))
    return rows.select(
        F.col("conv").alias(conv), F.when(orphan, F.col("answer.turn").cast("long")).otherwise(F.coalesce(F.when(~F.col("repeated"), F.col("at.turn")), F.col("turn").cast("long"))).alias("order_turn"), F.coalesce(F.when(~F.col("repeated"), F.col("at.hop")), F.lit(0).cast("long")).alias("order_hop"),
        F.coalesce("turn", "answer.turn").cast("long").alias("turn"), F.col("place").cast("long").alias("call_index"), F.col("id").alias("call_id"), "name", status.alias("status"), F.array_join(problems, "; ").alias("errors"),
        F.to_json(body, {"ignoreNullFields": "true"}).alias("json"))
