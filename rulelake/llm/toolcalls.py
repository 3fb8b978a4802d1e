"""Tool-call linking, in DataFrame operations only.

Calls and results meet in a hash join by conversation and identifier.  Arguments are parsed as JSON, checked against
the tool's schema and serialised canonically (keys sorted, no blanks).  A call may need others: arguments name them as
``{{identifier}}``.  Events are put in a topological order: a result never stands before its call nor a call before the
result of one it needs (or before that call, if it has no result), and apart from that the conversation's turns decide.

Only a need of something later than the call itself moves it.  Places are found in rounds of one hash join, in which
chains and trees of needs halve; calls that need several others, each of which again needs several, settle layer by
layer.  Calls that need themselves, or hang on such calls, are ``cyclic`` and stand at their turn; what other calls or
other conversations need has no part in that.

A conversation may hold a third of all events: positions come from counts by blocks of turns and an order inside
the block, so no task orders a whole conversation.

Defined results: calls and results with a null conversation or identifier are unanswered calls and orphan results;
of several calls (results) of one identifier the first by turn and content is linked and the others are duplicates;
arguments that are no JSON object, or repeat a key, are ``unparsable``, serialised as null and need nothing; a need of
an identifier that no call of the conversation has is the complaint ``dangling``; duplicate calls need nothing; a null turn stands first; repeated rows
are events of their own; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Table

#: Turns of a block whose events one task orders.
TURNS = 256
#: How arguments name a call, and the place of a null turn.
NEED, FIRST = r"\{\{([^{}\"\\]+)\}\}", -(1 << 62)


def json_string(value: Column) -> Column:
    """A JSON string, or null."""
    told = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(told, F.lit(2), F.length(told) - 2))


def errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """Sorted complaints about arguments (JSON text) under {tool: {field: (type, required, least, most)}}."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.array(F.lit("unknown_tool"))
    for tool, fields in schemas.items():
        known = F.array(*[F.lit(f) for f in fields])
        found = [F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k))]
        for field, (kind, required, least, most) in fields.items():
            kinds = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}
            there = F.coalesce(F.array_contains(keys, field), F.lit(False))
            shape = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            right = F.coalesce(shape == kinds[kind] if kind in kinds else shape.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False))
            number = F.try_variant_get(parsed, f"$.{field}", "double")
            value = F.length(F.try_variant_get(parsed, f"$.{field}", "string")) if kind == "string" else number
            far = F.lit(False)
            if least is not None:
                far = far | (value < least)
            if most is not None:
                far = far | (value > most)
            complaint = F.when(~there, F.lit(f"missing:{field}") if required else F.lit(None)).when(~right, F.lit(f"type:{field}")).when(
                F.coalesce(far, F.lit(False)), F.lit(f"range:{field}"))
            found.append(F.array(complaint))
        out = F.when(name == tool, F.array_sort(F.array_compact(F.concat(*found)))).otherwise(out)
    return F.when(keys.isNull() | parsed.isNull(), F.array(F.lit("unparsable"))).otherwise(out)


def link(calls: DataFrame, results: DataFrame, schemas: dict, turns: int = TURNS) -> DataFrame:
    """Events of calls (conv_id, turn, call_id, name, arguments) and results (conv_id, turn, call_id, content):
    conv_id, position, kind, call_id, turn, status, json."""
    key = ["conv_id", "call_id"]
    calls = calls.select(*key, "turn", "name", "arguments")
    results = results.select(*key, "turn", "content")
    first_call = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key).agg(
        F.min(F.struct("turn", "name", "arguments")).alias("c"))
    first_result = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key).agg(
        F.min(F.struct("turn", "content")).alias("r"))
    pair = first_call.join(first_result.hint("shuffle_hash"), key, "full")
    # equal repeated rows: one of them is the linked one
    copies = Window.partitionBy(*key, "turn", "name", "arguments").orderBy(F.lit(1))
    c = calls.withColumn("copy", F.row_number().over(copies)).join(pair.hint("shuffle_hash"), key, "left")
    lead = F.coalesce((F.col("copy") == 1) & F.struct("turn", "name", "arguments").eqNullSafe(F.col("c")), F.lit(False))
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    wrong = errors(F.col("name"), F.col("arguments"), schemas)
    c = c.withColumns({"wrong": wrong, "canonical": F.when(F.json_object_keys("arguments").isNotNull(), F.to_json(F.try_parse_json("arguments")))})
    at = F.coalesce(F.col("turn").cast("long"), F.lit(FIRST))
    named = Table(c.where(lead & keyed & F.contains("arguments", F.lit("{{")) & F.col("canonical").isNotNull()).select(
        *key, at.alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(NEED), F.lit(1)))).alias("needs")))
    known = pair.where("c IS NOT NULL").select("conv_id", F.col("call_id").alias("needs"), F.coalesce(F.col("c.turn").cast("long"), F.lit(FIRST)).alias("needs_at"),
                                               F.coalesce(F.col("r.turn").cast("long"), F.when(F.col("r").isNotNull(), F.lit(FIRST))).alias("answered_at"))
    needs = Table(named.df.join(known.hint("shuffle_hash"), ["conv_id", "needs"], "left"))
    named.drop()
    moved = _moved(needs.df.where("needs_at IS NOT NULL"))
    dangling = needs.df.where("needs_at IS NULL").groupBy(*key).agg(F.collect_set(F.concat(F.lit("dangling:"), "needs")).alias("dangling"))
    first = lambda *columns: [F.when(F.col("lead"), F.col(x)).alias(x) for x in columns]
    c = c.withColumn("lead", lead).join(moved, key, "left").join(dangling, key, "left")
    c = c.select(*key, "turn", "name", "c", "r", "canonical", "lead", "wrong", *first("after", "hops", "cyclic", "dangling"))
    c = c.withColumn("wrong", F.array_sort(F.concat("wrong", F.coalesce("dangling", F.array().cast("array<string>")))))
    status = F.when(keyed & ~F.col("lead"), "duplicate_call").when(F.size("wrong") > 0, "invalid").when(F.coalesce("cyclic", F.lit(False)), "cyclic").when(
        keyed & F.col("r").isNotNull(), "ok").otherwise("unanswered")
    answer = F.when(F.col("lead"), F.col("r.content"))
    c = c.withColumn("status", status).select(
        *key, "turn", F.lit("call").alias("kind"), "status", F.coalesce("after", at).alias("after"), F.coalesce("hops", F.lit(0)).alias("hops"),
        F.concat(F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"call_id":'), json_string(F.col("call_id")),
                 F.lit(',"errors":'), F.to_json("wrong"), F.lit(',"name":'), json_string(F.col("name")),
                 F.lit(',"result":'), json_string(answer), F.lit("}")).alias("json"))
    again = Window.partitionBy(*key, "turn", "content").orderBy(F.lit(1))
    r = results.withColumn("copy", F.row_number().over(again)).join(pair.hint("shuffle_hash"), key, "left").join(moved, key, "left")
    told = F.coalesce((F.col("copy") == 1) & F.struct("turn", "content").eqNullSafe(F.col("r")), F.lit(False))
    asked = F.coalesce("after", F.when(F.col("c").isNotNull(), F.coalesce(F.col("c.turn").cast("long"), F.lit(FIRST))))
    r = r.select(*key, "turn", F.lit("result").alias("kind"),
                 F.when(~keyed | F.col("c").isNull(), "orphan").when(told, "linked").otherwise("duplicate_result").alias("status"),
                 F.greatest(at, asked).alias("after"), F.when(asked >= at, F.coalesce("hops", F.lit(0))).otherwise(0).alias("hops"),
                 F.concat(F.lit('{"call_id":'), json_string(F.col("call_id")), F.lit(',"content":'), json_string(F.col("content")), F.lit("}")).alias("json"))
    events = c.unionByName(r).withColumn("block", F.floor(F.col("after") / turns))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = events.groupBy("conv_id", "block").count().select(
        F.col("conv_id").alias("k"), F.col("block").alias("b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "block").orderBy("after", "hops", "kind", "turn", "call_id", "json")
    return events.join(counts, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))).select(
        "conv_id", (F.col("base") + F.row_number().over(inside) - 1).alias("position"), "kind", "call_id", "turn", "status", "json")


def _moved(needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, after, hops, cyclic) of the calls with needs (conv_id, call_id, at, needs, needs_at, answered_at):
    they stand after the place ``after`` (their own, if nothing moves them), by so many hops behind what else stands there.

    A call's place is the greatest, over all that it reaches by m needs, of (turn of that call or of its result, m). In a
    round every need of a call with at most one need left is replaced by that one, or goes if there is none: chains and
    trees halve, and what only waits for several settles from its end. Calls whose needs lead back to them, or run on
    for more steps than their conversation has calls, or that no round moves, need themselves.
    """
    key = ["conv_id", "call_id"]
    place = lambda after, hops: F.struct(after.cast("long").alias("after"), hops.cast("long").alias("hops"))
    one = F.lit(1)
    first = needs.groupBy(*key).agg(
        F.greatest(F.max(place(F.col("at"), F.lit(0))), F.max(place(F.greatest("needs_at", "answered_at"), one))).alias("v"),
        F.collect_set(F.struct("needs", one.cast("long").alias("k"))).alias("out"))
    sizes = first.groupBy("conv_id").agg(F.count("*").alias("n"))
    now = Table(first.join(sizes, "conv_id").withColumn("cyclic", F.lit(False)))
    before = None
    while True:
        open_ = F.size("out") > 0
        told = tuple(now.df.agg(F.count_if(open_), F.sum(F.size("out")), F.sum(F.aggregate("out", F.lit(0).cast("long"), lambda total, x: total + x["k"])), F.count_if("cyclic")).first())
        if not told[0] or told == before:
            # what is open now can't be settled
            done = now.df.withColumn("cyclic", F.col("cyclic") | open_)
            return done.select(*key, F.when(~F.col("cyclic"), F.col("v.after")).alias("after"), F.when(~F.col("cyclic"), F.col("v.hops")).alias("hops"), "cyclic")
        before = told
        now, old = Table(_substituted(now.df)), now
        old.drop()


def _substituted(calls: DataFrame) -> DataFrame:
    """One round over calls (conv_id, call_id, v, out, n, cyclic): needs of calls with at most one need are replaced."""
    key = ["conv_id", "call_id"]
    each = calls.select(*key, "v", "n", "cyclic", F.explode_outer("out").alias("x")).select(*key, "v", "n", "cyclic", F.col("x.needs").alias("needs"), F.col("x.k").alias("k"))
    target = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("v").alias("tv"), F.col("out").alias("tout"), F.col("cyclic").alias("tc"))
    met = each.join(target.hint("shuffle_hash"), ["conv_id", "needs"], "left")
    edge = lambda needs, k: F.struct(needs.alias("needs"), k.cast("long").alias("k"))
    k, none = F.col("k"), F.array().cast("array<struct<needs:string,k:bigint>>")
    next_ = F.when(F.col("tc").isNull(), none).when(F.size("tout") <= 1, F.transform("tout", lambda x: edge(x["needs"], x["k"] + k))).otherwise(F.array(edge(F.col("needs"), k)))
    given = F.when(F.col("tc").isNotNull(), F.struct(F.col("tv.after").alias("after"), (F.col("tv.hops") + k).alias("hops")))
    back = F.coalesce("tc", F.lit(False)) | F.exists(next_, lambda x: (x["needs"] == F.col("call_id")) | (x["k"] > F.col("n")))
    met = met.select(*key, "v", "n", given.alias("given"), next_.alias("next"), (F.col("cyclic") | back).alias("circle"))
    new = met.groupBy(*key).agg(F.first("v").alias("own"), F.max("given").alias("most"), F.first("n").alias("size"), F.max("circle").alias("cyclic"),
                                F.array_sort(F.flatten(F.collect_list("next"))).alias("all"))
    longest = F.filter("all", lambda x, i: ~F.coalesce(F.get("all", i + 1)["needs"] == x["needs"], F.lit(False)))  # of several ways to a call the longest
    return new.select(*key, F.greatest("own", "most").alias("v"), F.when(F.col("cyclic"), none).otherwise(longest).alias("out"), F.col("size").alias("n"), "cyclic")


# The query: the table conversations has no calls, so turns stand for them by rule: a user's turn is a call of one of
# three tools with its text and length as arguments, an assistant's turn the result of the call one turn before. A lookup
# needs the search that the user makes two turns later.

SCHEMAS = {
    "search": {"query": ("string", True, 1, None), "limit": ("integer", True, 0, 300)},
    "lookup": {"query": ("string", True, 40, None), "limit": ("integer", False, None, None), "source": ("string", True, 5, None)},
    "translate": {"query": ("string", True, None, 200), "language": ("string", True, None, None)},
}


def calls_of(conversations: DataFrame) -> DataFrame:
    turn = F.col("turn")
    name = F.when(F.pmod(turn, F.lit(4)) == 0, "search").when(F.pmod(turn, F.lit(8)) == 2, "lookup").otherwise("translate")
    return conversations.where("role = 'user'").select(
        "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("call_id"), name.alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("limit"), F.when(name == "lookup", F.concat(
            F.lit("{{"), F.concat_ws("-", "conv_id", turn + 2), F.lit("}}"))).alias("source"))).alias("arguments"))


def results_of(conversations: DataFrame) -> DataFrame:
    return conversations.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS call_id, text, conv_id || '-' || (turn + 2) AS needs,
         CASE WHEN turn % 4 = 0 THEN 'search' WHEN turn % 8 = 2 THEN 'lookup' ELSE 'translate' END AS name, length(text) AS n
  FROM conversations WHERE role = 'user'
), r AS (
  SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'
), d AS (
  SELECT c.*, CASE WHEN c.name = 'lookup' THEN greatest(t.turn, r.turn) END AS later, c.name = 'lookup' AND t.call_id IS NULL AS lost
  FROM c LEFT JOIN c t ON c.name = 'lookup' AND t.conv_id = c.conv_id AND t.call_id = c.needs LEFT JOIN r ON r.conv_id = t.conv_id AND r.call_id = t.call_id
), c1 AS (
  SELECT *, CASE name
      WHEN 'search' THEN list_concat(CASE WHEN n < 1 THEN ['range:query'] ELSE [] END, CASE WHEN n > 300 THEN ['range:limit'] ELSE [] END)
      WHEN 'lookup' THEN list_concat(CASE WHEN n < 40 THEN ['range:query'] ELSE [] END, CASE WHEN lost THEN ['dangling:' || needs] ELSE [] END)
      ELSE list_concat(['missing:language', 'unknown:limit'], CASE WHEN n > 200 THEN ['range:query'] ELSE [] END) END AS e
  FROM d
), x AS (
  SELECT c1.conv_id, 'call' AS kind, c1.call_id, c1.turn, coalesce(later, c1.turn) AS after, CASE WHEN later IS NULL THEN 0 ELSE 1 END AS hops,
         CASE WHEN len(e) > 0 THEN 'invalid' WHEN r.call_id IS NOT NULL THEN 'ok' ELSE 'unanswered' END AS status,
         '{"arguments":{"limit":' || n || ',"query":' || CAST(to_json(c1.text) AS VARCHAR) || CASE WHEN name = 'lookup' THEN ',"source":"{{' || needs || '}}"' ELSE '' END
         || '},"call_id":"' || c1.call_id || '","errors":' || CAST(to_json(list_sort(e)) AS VARCHAR) || ',"name":"' || name || '","result":'
         || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS json
  FROM c1 LEFT JOIN r ON c1.conv_id = r.conv_id AND c1.call_id = r.call_id
  UNION ALL
  SELECT r.conv_id, 'result', r.call_id, r.turn, greatest(r.turn, c1.turn, later), CASE WHEN later >= r.turn THEN 1 ELSE 0 END, CASE WHEN c1.call_id IS NULL THEN 'orphan' ELSE 'linked' END,
         '{"call_id":"' || r.call_id || '","content":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}'
  FROM r LEFT JOIN c1 ON c1.conv_id = r.conv_id AND c1.call_id = r.call_id
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY after, hops, kind, turn, call_id, json) - 1 AS position, kind, call_id, turn, status, json FROM x
"""
