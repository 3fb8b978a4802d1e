"""Registered queries: each applies an operator to whole driver tables, beside the SQL that must give the same rows.

The driver tables play the parts of the engine's inputs: customers, orders and nations are facts; events are journals
and action logs; suppliers and parts are graph nodes; documents are audited files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .model import Action, Condition, Rule
from .operators import audit, coverage, drift, facts, graph, journey, outcomes, scrub, stats
from .plans import policy, rules
from .plans.tables import spread

NOW, SID = 1_706_659_200, "7"  # 2024-01-31 00:00 UTC
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- facts and rules

FACTS = """facts AS (
  SELECT 'customer:' || c_custkey AS id, 'customer' AS predicate, CAST(c_custkey AS VARCHAR) AS a0, CAST(c_nationkey AS VARCHAR) AS a1, c_mktsegment AS a2 FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'order', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus FROM orders
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', CAST(n_nationkey AS VARCHAR), n_name, NULL FROM nation
)"""


def fact_table(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str, *columns: str) -> DataFrame:
        t = table(spark, d, {"order": "orders"}.get(name, name))
        return t.select(F.concat(F.lit(f"{name}:"), F.col(key)).alias("id"), F.lit(name).alias("predicate"), F.array(*[F.col(c).cast("string") for c in columns]).alias("args"),
                        F.lit(0).cast("long").alias("timestamp"), F.lit(name).alias("source"))
    return of("customer", "c_custkey", "c_custkey", "c_nationkey", "c_mktsegment").unionByName(
        of("order", "o_orderkey", "o_orderkey", "o_custkey", "o_orderstatus")).unionByName(of("nation", "n_nationkey", "n_nationkey", "n_name"))


def cond(predicate: str, *args: str) -> Condition:
    return Condition(predicate, args)


def warn(*params: str) -> Action:
    return Action("constraint_warning", params)


FINISHED = Rule("finished", (cond("order", "?o", "?c", "F"), cond("customer", "?c", "?n", "?seg"), cond("nation", "?n", "?name")),
                (warn("Order ?o of ?c in ?name is finished"),), 10)


@query("j1_three_way_rule", f"""WITH {FACTS}
SELECT 'finished' AS rule_id, 10 AS salience, 'constraint' AS kind, 'constraint_warning' AS action_type,
       'Order ' || o.a0 || ' of ' || c.a0 || ' in ' || n.a1 || ' is finished' AS message, o.id || ',' || c.id || ',' || n.id AS fact_ids
FROM facts o JOIN facts c ON o.predicate = 'order' AND o.a2 = 'F' AND c.predicate = 'customer' AND c.a0 = o.a1 JOIN facts n ON n.predicate = 'nation' AND n.a0 = c.a1""")
def rules_three_way(spark, d):
    fired = rules.Session(fact_table(spark, d), [FINISHED]).fire()
    return fired.select("rule_id", "salience", "kind", "action_type", "message", F.array_join("fact_ids", ",").alias("fact_ids"))


@query("s1_predicate_scan", f"WITH {FACTS} SELECT id, a0 || ',' || a1 AS args FROM facts WHERE predicate = 'nation'")
def _(spark, d):
    return facts.by_predicate(fact_table(spark, d), "nation").select("id", F.array_join("args", ",").alias("args"))


@query("s2_snapshot", f"WITH {FACTS} SELECT id, predicate FROM facts")
def _(spark, d):
    return facts.snapshot(fact_table(spark, d)).select("id", "predicate")


@query("s3_point_lookup", f"WITH {FACTS} SELECT id, a1 AS name FROM facts WHERE id = 'nation:3'")
def _(spark, d):
    return facts.by_id(fact_table(spark, d), "nation:3").select("id", F.col("args")[1].alias("name"))


@query("p4_positional_filter", f"WITH {FACTS} SELECT id FROM facts WHERE predicate = 'order' AND a2 = 'P'")
def _(spark, d):
    return facts.matching_ids(fact_table(spark, d), "order", [(2, "P")])


@query("p5_predicate_set", f"WITH {FACTS} SELECT predicate, count(DISTINCT id) AS n FROM facts WHERE predicate IN ('customer', 'nation') GROUP BY 1")
def _(spark, d):
    return facts.by_predicates(fact_table(spark, d), ["customer", "nation"]).groupBy("predicate").agg(F.count("*").alias("n"))


@query("p2_repeated_variable", """SELECT 'same' AS rule_id, l_orderkey || ':' || l_linenumber AS fact_id, l_linenumber AS x
FROM lineitem WHERE l_linenumber = CAST(l_quantity AS INT)""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.lit("line").alias("predicate"), F.array(
        F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("args"), F.lit(0).alias("timestamp"), F.lit(None).cast("string").alias("source"))
    rows = rules.activations(li, Rule("same", (cond("line", "?x", "?x"),), (warn("?x"),)))
    return rows.select("rule_id", F.col("fact_ids")[0].alias("fact_id"), F.col("bindings")["?x"].cast("int").alias("x"))


@query("j2_cartesian", "SELECT n_name AS a, r_name AS b FROM nation, region")
def _(spark, d):
    t = table(spark, d, "nation")
    f = facts.facts_of(t, "n", ["n_name"]).unionByName(facts.facts_of(table(spark, d, "region"), "r", ["r_name"]))
    rows = rules.activations(f, Rule("pairs", (cond("n", "?a"), cond("r", "?b")), (warn("?a ?b"),)))
    return rows.select(F.col("`?a`").alias("a"), F.col("`?b`").alias("b"))


@query("j4_self_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b USING (s_nationkey)")
def _(spark, d):
    f = facts.facts_of(table(spark, d, "supplier"), "in", ["s_suppkey", "s_nationkey"])
    rows = rules.activations(f, Rule("peers", (cond("in", "?a", "?n"), cond("in", "?b", "?n")), (warn("?a"),)))
    return rows.select(F.col("`?a`").cast("long").alias("a"), F.col("`?b`").cast("long").alias("b"))


def guarded(spark, d, script: str) -> DataFrame:
    rule = Rule("g", (cond("customer", "?c", "?n", "?s"), Condition(script=script)), (warn("?c"),))
    return rules.activations(fact_table(spark, d), rule).select(F.col("`?c`").cast("long").alias("c"))


@query("j9_exists_guard", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(spark, d):
    return guarded(spark, d, "facts_contain('order', ['*', '?c', 'F'])")


@query("j10_absent_guard", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(spark, d):
    return guarded(spark, d, "!facts_contain('order', ['*', '?c', 'P'])")


@query("j11_count_guard", "SELECT c_custkey AS c FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) <= 8")
def _(spark, d):
    return guarded(spark, d, "facts_count('order', ['*', '?c']) <= 8")


TWO = [FINISHED, Rule("low", (cond("customer", "?c", "?n", "BUILDING"), cond("nation", "?n", "?name")), (Action("constraint_violation", ("?c builds in ?name", "?where")),), 20),
       Rule("note", (cond("nation", "?n", "?name"),), (Action("log", ("?name",)),), 5)]


@query("o1_agenda_order", f"""WITH {FACTS}, a AS (
  SELECT 'finished' AS rule_id, 10 AS salience, 0 AS ord, o.id || ',' || c.id || ',' || n.id AS ids FROM facts o JOIN facts c ON o.predicate = 'order' AND o.a2 = 'F' AND c.predicate = 'customer' AND c.a0 = o.a1 JOIN facts n ON n.predicate = 'nation' AND n.a0 = c.a1
  UNION ALL SELECT 'low', 20, 1, c.id || ',' || n.id FROM facts c JOIN facts n ON c.predicate = 'customer' AND c.a2 = 'BUILDING' AND n.predicate = 'nation' AND n.a0 = c.a1
  UNION ALL SELECT 'note', 5, 2, id FROM facts WHERE predicate = 'nation')
SELECT salience, rule_id, count(*) AS n, min(ids) AS first_ids FROM a GROUP BY ALL""")
def _(spark, d):
    agenda = rules.Session(fact_table(spark, d), TWO).agenda()
    return agenda.groupBy("salience", "rule_id").agg(F.count("*").alias("n"), F.min(F.array_join("fact_ids", ",")).alias("first_ids")).orderBy(F.desc("salience"))


@query("p26_substitution", f"""WITH {FACTS} SELECT 'low' AS rule_id, c.a0 || ' builds in ' || n.a1 || ' ?where' AS message, '?where' AS unbound
FROM facts c JOIN facts n ON c.predicate = 'customer' AND c.a2 = 'BUILDING' AND n.predicate = 'nation' AND n.a0 = c.a1""")
def _(spark, d):
    fired = rules.Session(fact_table(spark, d), TWO[1:2]).fire()
    return fired.select("rule_id", "message", F.array_join("unbound_variables", ",").alias("unbound"))


@query("a22_verdict", """SELECT 'warn' AS verdict, 0 AS blocks, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
+ (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS warnings""")
def _(spark, d):
    return rules.verdict(rules.Session(fact_table(spark, d), TWO).fire(), demote=["low"])


@query("u8_or_expansion", f"""WITH {FACTS} SELECT 'st#or' || (CASE a2 WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS rule_id, count(*) AS n FROM facts WHERE predicate = 'order' GROUP BY 1""")
def _(spark, d):
    flat, _ = policy.parse('{"rules":[{"id":"st","when":[{"or":[{"order":["?o","?c","F"]},{"or":[{"order":["?o","?c","O"]},{"order":["?o","?c","P"]}]}]}],"then":{"log":"?o"}}]}')
    return rules.Session(fact_table(spark, d), flat).fire().groupBy("rule_id").agg(F.count("*").alias("n"))


@query("u13_refraction", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(spark, d):
    f = fact_table(spark, d)
    every = rules.activations(f, Rule("r", (cond("customer", "?c", "?n", "?s"),), (warn("?c"),)))
    before = rules.activations(f, Rule("r", (cond("customer", "?c", "?n", "BUILDING"),), (warn("?c"),)))
    return rules.annotated_delta(every, before).select(F.col("`?c`").cast("long").alias("c"))


@query("j7_retraction", "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey <> 4")
def _(spark, d):
    s = rules.Session(fact_table(spark, d), [Rule("r", (cond("customer", "?c", "?n", "?s"), cond("nation", "?n", "?x")), (warn("?c"),))])
    s.retract(spark.createDataFrame([("nation:4",)], "id string"))
    return s.agenda().agg(F.count("*").alias("n"))


@query("u4_layers", """WITH l AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS layer, o_orderkey AS ord, 'r' || o_custkey AS rule_id FROM orders), w AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY layer DESC, ord DESC) AS rn, first_value(layer) OVER (PARTITION BY rule_id ORDER BY layer, ord) AS place_layer,
         first_value(ord) OVER (PARTITION BY rule_id ORDER BY layer, ord) AS place_ord FROM l)
SELECT layer, ord, rule_id, place_layer, place_ord FROM w WHERE rn = 1""")
def _(spark, d):
    return policy.compose_tables(layered(spark, d))[0]


@query("u4_overrides", """WITH l AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS layer, o_orderkey AS ord, 'r' || o_custkey AS rule_id FROM orders), w AS (
  SELECT rule_id, lag(layer) OVER (PARTITION BY rule_id ORDER BY layer, ord) AS b, layer FROM l)
SELECT b AS loser_layer, layer AS winner_layer, count(*) AS n FROM w WHERE b IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return policy.compose_tables(layered(spark, d))[1].groupBy("loser_layer", "winner_layer").agg(F.count("*").alias("n"))


def layered(spark, d):
    layer = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, d, "orders").select(layer.alias("layer"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("r"), "o_custkey").alias("rule_id"))


@query("n5_occurrence", """SELECT n, count(*) AS facts FROM (SELECT row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY 1""")
def _(spark, d):
    f = table(spark, d, "orders").select("o_orderkey", F.lit("o").alias("predicate"), F.array(F.col("o_custkey").cast("string"), "o_orderstatus").alias("args"))
    return rules.occurrence(f, "o_orderkey").groupBy(F.col("occurrence").alias("n")).agg(F.count("*").alias("facts"))


# ---------------------------------------------------------------- journals

J = """j AS (SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(user_id AS VARCHAR) AS sid, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  'p' || json_extract_string(props, '$.k') AS path, 'm' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) AS module, event_type AS tag, value > 100 AS big,
  's' || (user_id % 20) AS subject, CASE WHEN event_type = 'signup' THEN 'prompt' END AS kind, event_type FROM events),
  jt AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS back FROM j WHERE kind IS NULL)"""


def journal(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("user_id").cast("string").alias("sid"), k.alias("k"),
        F.concat(F.lit("p"), k).alias("path"), F.concat(F.lit("m"), k % 5).alias("module"),
        F.when(F.col("value") > 100, F.array("event_type", F.lit("big"))).otherwise(F.array("event_type")).alias("tags"),
        F.concat(F.lit("s"), F.col("user_id") % 20).alias("subject"), F.when(F.col("event_type") == "signup", "prompt").alias("kind"), "event_type")


@query("w1_occurrences", f"WITH {J} SELECT 'error' AS selector, '3d' AS \"window\", seq FROM j WHERE tag = 'error' AND ts + 259200 >= {NOW}")
def _(spark, d):
    return journey.occurrences(journal(spark, d), "error", "3d", SID, NOW)


@query("w2_counts", f"""WITH {J} SELECT 'error' AS selector, '2d' AS "window", count(*) FILTER (tag = 'error') AS n FROM j WHERE ts + 172800 >= {NOW}
UNION ALL SELECT 'big', 's', count(*) FILTER (big) FROM j WHERE sid = '{SID}' UNION ALL SELECT 'error', '500c', count(*) FILTER (tag = 'error') FROM jt WHERE back <= 500
UNION ALL SELECT 'module:m3', '500c', count(*) FILTER (module = 'm3') FROM jt WHERE back <= 500 UNION ALL SELECT 'none', '1h', 0""")
def _(spark, d):
    return journey.counts(journal(spark, d), [("error", "2d"), ("big", "s"), ("error", "500c"), ("module:m3", "500c"), ("none", "1h")], SID, NOW)


@query("w10_many_windows", f"""WITH {J}, a AS (SELECT seq, sid, ts AS now, s AS selector, w AS "window" FROM j, (VALUES ('error', '1d', 86400, 0), ('module:m3', '6h', 21600, 0), ('big', '300c', 0, 300), ('view', 's', 0, 0)) t(s, w, secs, calls) WHERE tag = 'signup')
SELECT seq, selector, "window", CASE "window" WHEN '1d' THEN (SELECT count(*) FROM j WHERE tag = 'error' AND j.ts + 86400 >= a.now) WHEN '6h' THEN (SELECT count(*) FROM j WHERE module = 'm3' AND j.ts + 21600 >= a.now)
  WHEN '300c' THEN (SELECT count(*) FROM jt WHERE big AND back <= 300) ELSE (SELECT count(*) FROM j WHERE tag = 'view' AND j.sid = a.sid) END AS n FROM a""")
def _(spark, d):
    # every sign-up asks for four windows of its own session and time
    rows = journal(spark, d)
    four = F.array(*[F.struct(F.lit(s).alias("selector"), F.lit(w).alias("window")) for s, w in (("error", "1d"), ("module:m3", "6h"), ("big", "300c"), ("view", "s"))])
    asked = rows.where("event_type = 'signup'").select("seq", "sid", F.col("ts").alias("now"), F.inline(four))
    return journey.many_counts(rows, asked).select("seq", "selector", "window", "n")


@query("w3_seen", f"""WITH {J} SELECT 'error' AS selector, '5h' AS "window" WHERE EXISTS (SELECT 1 FROM j WHERE tag = 'error' AND ts + 18000 >= {NOW})
UNION ALL SELECT 'purchase', 's' WHERE EXISTS (SELECT 1 FROM j WHERE tag = 'purchase' AND sid = '{SID}')""")
def _(spark, d):
    return journey.seen(journal(spark, d), [("error", "5h"), ("purchase", "s"), ("none", "30d")], SID, NOW)


@query("w4_since", f"""WITH {J}, l AS (SELECT max(seq) AS s FROM j WHERE kind IS NULL AND big), n AS (SELECT count(*) AS n FROM j, l WHERE kind IS NULL AND seq > s)
SELECT 'big' AS selector, k FROM (SELECT unnest(range(1, least(n, 20) + 1)) AS k FROM n)""")
def _(spark, d):
    return journey.since(journal(spark, d), "big", 20)


@query("w5_distinct", f"""WITH {J} SELECT 'path' AS field, '4d' AS "window", count(DISTINCT path) AS n FROM j WHERE kind IS NULL AND ts + 345600 >= {NOW}""")
def _(spark, d):
    return journey.distinct_paths(journal(spark, d), "4d", SID, NOW)


@query("w6_filtered_since", f"""WITH {J}, l AS (SELECT max(seq) AS s FROM j WHERE big), n AS (SELECT count(*) AS n FROM j, l WHERE tag = 'view' AND seq > s)
SELECT 'big' AS target, 'view' AS counted, k FROM (SELECT unnest(range(1, least(n, 50) + 1)) AS k FROM n)""")
def _(spark, d):
    return journey.filtered_since(journal(spark, d), "big", "view", 50)


@query("w7_call_window", f"WITH {J} SELECT seq, tag FROM jt WHERE back <= 200")
def _(spark, d):
    return journey.window(journal(spark, d), "200c", SID, NOW).select("seq", F.col("event_type").alias("tag"))


@query("w9_session_window", f"WITH {J} SELECT seq FROM j WHERE sid = '{SID}'")
def _(spark, d):
    return journey.window(journal(spark, d), "s", SID, NOW).select("seq")


@query("w11_asked_facts", f"""WITH {J} SELECT 'journey_count' AS predicate, 'error,1d,' || count(*) FILTER (tag = 'error') AS args FROM j WHERE ts + 86400 >= {NOW}
UNION ALL SELECT 'journey_seen', 'view,s' WHERE EXISTS (SELECT 1 FROM j WHERE tag = 'view' AND sid = '{SID}')""")
def _(spark, d):
    asked = [Rule("a", (cond("journey_count", "error", "1d", "?n"), cond("journey_seen", "view", "s")), (warn("x"),))]
    return journey.facts(journal(spark, d), asked, SID, NOW).select("predicate", F.array_join("args", ",").alias("args"))


@query("s5_tail", f"WITH {J} SELECT seq, sid FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS r FROM j) WHERE r <= 100")
def _(spark, d):
    return journey.tail(journal(spark, d), 100).select("seq", "sid")


@query("s6_subject_tail", f"WITH {J} SELECT seq FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS r FROM j WHERE subject = 's3') WHERE r <= 25")
def _(spark, d):
    return journey.subject_tail(journal(spark, d), "s3", 25).select("seq")


@query("w14_prompt_class", f"""WITH {J}, e AS (SELECT seq, sid, CASE tag WHEN 'signup' THEN 'prompt' WHEN 'error' THEN 'interrupt' WHEN 'purchase' THEN 'stop' ELSE 'tool' END AS event, k % 3 = 0 AS interrupted FROM j),
w AS (SELECT *, lag(event) OVER (PARTITION BY sid ORDER BY seq) AS last, last_value(CASE WHEN event IN ('prompt', 'stop') THEN event END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM e)
SELECT sid, seq, CASE WHEN last = 'interrupt' THEN 'correction' WHEN coalesce(turn, '') <> 'prompt' THEN 'fresh' WHEN interrupted THEN 'correction' ELSE 'mid_turn' END AS mode FROM w WHERE event = 'prompt'""")
def _(spark, d):
    event = F.when(F.col("event_type") == "signup", "prompt").when(F.col("event_type") == "error", "interrupt").when(F.col("event_type") == "purchase", "stop").otherwise("tool")
    rows = journal(spark, d).select("sid", "seq", event.alias("event"), F.lit(None).cast("string").alias("agent"), (F.col("k") % 3 == 0).alias("interrupted"))
    return journey.prompt_class(rows).select("sid", "seq", "mode")


@query("a14_compaction", f"""WITH {J}, alive AS (SELECT subject FROM j GROUP BY 1 ORDER BY max(seq) DESC LIMIT 10),
t AS (SELECT max(seq) AS seq FROM j JOIN alive USING (subject) WHERE tag IN ('error', 'view') GROUP BY subject, tag)
SELECT count(*) AS n, sum(seq) AS s FROM j WHERE kind IS NOT NULL OR seq IN (SELECT seq FROM t) OR seq IN (SELECT seq FROM j ORDER BY seq DESC LIMIT 300)""")
def _(spark, d):
    signal = F.transform(F.filter("tags", lambda t: t.isin("error", "view")), lambda t: F.concat(F.lit("signal:"), t, F.lit("=1")))
    return journey.compacted(journal(spark, d).withColumn("tags", signal), 300, 10).agg(F.count("*").alias("n"), F.sum("seq").alias("s"))


@query("s22_clock_facts", """SELECT lower(dayname(ts)) AS weekday_local, CAST(hour(ts) AS VARCHAR) AS hour_local, CASE WHEN isodow(ts) <= 5 AND hour(ts) BETWEEN 9 AND 16 THEN 'true' ELSE 'false' END AS business_hours_local, count(*) AS n FROM events GROUP BY ALL""")
def _(spark, d):
    c = T.clock(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(*[v.alias(k) for k, v in c.items()]).groupBy(*c).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- action logs

L = f"""{J}, lg AS (SELECT seq, ts, sid, subject, k, CASE WHEN tag = 'click' THEN 'check' ELSE 'lifecycle' END AS kind,
  CASE tag WHEN 'view' THEN 'prompt' WHEN 'signup' THEN 'interrupt' WHEN 'error' THEN 'stop' WHEN 'purchase' THEN 'commit' END AS event,
  CASE WHEN tag = 'view' THEN CASE k % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'correction' ELSE 'mid_turn' END END AS mode,
  CASE WHEN tag = 'click' THEN k % 3 END AS exit, CASE WHEN tag = 'click' THEN CASE k % 2 WHEN 0 THEN 'pre' ELSE 'post' END END AS phase,
  CASE WHEN tag = 'click' THEN 't' || (k % 4) END AS tool, CASE WHEN tag = 'error' THEN k END AS duration, tag = 'error' AND k % 2 = 0 AS matched,
  CASE WHEN tag = 'purchase' THEN CASE WHEN k < 30 THEN 'low' WHEN k < 60 THEN 'medium' ELSE 'high' END END AS band,
  CASE WHEN tag = 'click' THEN 'r' || (k % 7) END AS rule, CASE WHEN tag = 'click' THEN CASE k % 5 WHEN 0 THEN 'constraint_violation' WHEN 1 THEN 'constraint_warning' WHEN 2 THEN 'log' END END AS act FROM j)"""


def action_log(spark, d):
    t, k = F.col("event_type"), F.col("k")
    click = t == "click"
    act = F.when(k % 5 == 0, "constraint_violation").when(k % 5 == 1, "constraint_warning").when(k % 5 == 2, "log")
    return journal(spark, d).select(
        "seq", "ts", "sid", "subject", "k", F.when(click, "check").otherwise("lifecycle").alias("kind"),
        F.when(t == "view", "prompt").when(t == "signup", "interrupt").when(t == "error", "stop").when(t == "purchase", "commit").alias("event"),
        F.when(t == "view", F.when(k % 3 == 0, "fresh").when(k % 3 == 1, "correction").otherwise("mid_turn")).alias("mode"),
        F.when(click, k % 3).alias("exit"), F.when(click, F.when(k % 2 == 0, "pre").otherwise("post")).alias("phase"), F.when(click, F.concat(F.lit("t"), k % 4)).alias("tool"),
        F.when(t == "error", k.cast("long")).alias("duration_secs"), ((t == "error") & (k % 2 == 0)).alias("matched_start"),
        F.when(t == "purchase", F.when(k < 30, "low").when(k < 60, "medium").otherwise("high")).alias("confidence_band"), F.lit("k1").alias("kalpa"), "tags",
        F.when(click & act.isNotNull(), F.array(F.struct(F.concat(F.lit("r"), k % 7).alias("rule_id"), act.alias("action_type")))).otherwise(
            F.array().cast("array<struct<rule_id string, action_type string>>")).alias("consequences"))


@query("a2_rule_stats", f"""WITH {L} SELECT rule AS rule_id, count(*) FILTER (act = 'constraint_violation') AS blocked, count(*) FILTER (act = 'constraint_warning') AS warned, count(*) AS total, max(ts) AS last_ts
FROM lg WHERE act IN ('constraint_violation', 'constraint_warning') GROUP BY 1""")
def _(spark, d):
    return stats.rule_stats(action_log(spark, d))


@query("a3_lifecycle", f"""WITH {L}, x AS (SELECT * FROM lg WHERE kind = 'lifecycle'), m AS (SELECT duration, row_number() OVER (ORDER BY duration) AS r, count(*) OVER () AS n FROM x WHERE event = 'stop' AND matched)
SELECT count(*) AS events, count(DISTINCT sid) AS sessions, count(*) FILTER (event = 'prompt') AS prompts, count(*) FILTER (mode = 'correction') AS corrections, count(*) FILTER (mode = 'mid_turn') AS mid_turn,
  count(*) FILTER (event = 'interrupt') AS interrupts, count(*) FILTER (event = 'commit') AS commits, count(*) FILTER (band = 'high') AS band_high, count(*) FILTER (band = 'medium') AS band_medium, count(*) FILTER (band = 'low') AS band_low,
  (SELECT CAST(floor((min(duration) + max(duration)) / 2) AS BIGINT) FROM m WHERE r IN ((n + 1) // 2, n // 2 + 1)) AS median_secs FROM x""")
def _(spark, d):
    return stats.lifecycle(action_log(spark, d)).drop("interventions", "per_commit")


@query("a3_by_event", f"WITH {L} SELECT event, count(*) AS n FROM lg WHERE kind = 'lifecycle' GROUP BY 1")
def _(spark, d):
    return stats.by_event(action_log(spark, d))


@query("a4_median", f"""WITH {L}, m AS (SELECT subject, duration, row_number() OVER (PARTITION BY subject ORDER BY duration) AS r, count(*) OVER (PARTITION BY subject) AS n FROM lg WHERE duration IS NOT NULL)
SELECT subject, CAST(floor((min(duration) + max(duration)) / 2) AS BIGINT) AS median FROM m WHERE r IN ((n + 1) // 2, n // 2 + 1) GROUP BY 1""")
def _(spark, d):
    return stats.integer_median(action_log(spark, d), "duration_secs", ["subject"])


@query("a6_work_items", f"""WITH {L}, i AS (SELECT sid, bool_or(event = 'interrupt') AS explicit, bool_or(event = 'commit') AS completed, bool_or(kind = 'check') AS evaluated, arg_max(band, ts) FILTER (band IS NOT NULL) AS band FROM lg GROUP BY 1)
SELECT count(*) FILTER (explicit) AS explicit, count(*) FILTER (NOT coalesce(explicit, false)) AS implicit, count(*) FILTER (completed) AS completed, count(*) FILTER (completed AND evaluated AND band IS DISTINCT FROM 'low') AS governed FROM i""")
def _(spark, d):
    log = action_log(spark, d).withColumns({"subject": F.col("sid"), "event": F.when(F.col("event") == "interrupt", "work_start").otherwise(F.col("event"))})
    return stats.work_items(log)


@query("a8_hook_checks", f"""WITH {L} SELECT phase, tool, CASE WHEN exit <> 0 THEN 'block' WHEN act = 'constraint_warning' THEN 'warn' ELSE 'allow' END AS decision, count(*) AS n FROM lg WHERE kind = 'check' GROUP BY ALL""")
def _(spark, d):
    return stats.hook_checks(action_log(spark, d))


@query("a9_capped_fires", f"""WITH {L}, t AS (SELECT 'q' || (k % 23) AS rule_id, count(*) AS n FROM lg GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, rule_id) AS rn FROM t)
SELECT CASE WHEN rn <= 5 THEN rule_id ELSE '__other__' END AS rule_id, sum(n) AS n FROM r GROUP BY 1""")
def _(spark, d):
    return stats.capped(action_log(spark, d).select(F.concat(F.lit("q"), F.col("k") % 23).alias("rule_id"), F.lit(1).alias("n")), "rule_id", "n", 5)


@query("a11_histogram", """SELECT event_type, CASE WHEN i = 13 THEN '+Inf' ELSE CAST(CAST(pow(2, i) AS DOUBLE) AS VARCHAR) END AS le, count(*) FILTER (i = 13 OR value <= pow(2, i)) AS n
FROM events, range(14) t(i) WHERE value IS NOT NULL GROUP BY event_type, i""")
def _(spark, d):
    return stats.histogram(table(spark, d, "events"), "value", by=["event_type"])


@query("a18_trend", f"""WITH {J}, s AS (SELECT ts // 86400 AS snapshot, tag AS rule_id, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE count(*) END AS hits FROM j GROUP BY ALL)
SELECT rule_id, arg_min(hits, snapshot) FILTER (hits IS NOT NULL) AS first_hits, arg_max(hits, snapshot) FILTER (hits IS NOT NULL) AS last_hits, count(hits) AS known,
  arg_max(hits, snapshot) FILTER (hits IS NOT NULL) - arg_min(hits, snapshot) FILTER (hits IS NOT NULL) AS net FROM s GROUP BY 1 HAVING count(hits) > 0""")
def _(spark, d):
    daily = journal(spark, d).groupBy(F.expr("ts div 86400").alias("snapshot"), F.col("event_type").alias("rule_id")).agg(F.count("*").alias("n"))
    return stats.trend(daily.select("snapshot", "rule_id", F.when(F.col("n") % 7 != 0, F.col("n")).alias("hits")))


@query("a23_unit_report", f"""WITH {L}, t AS (SELECT subject, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT subject, tag FROM j UNION ALL SELECT subject, 'big' FROM j WHERE big) GROUP BY 1)
SELECT subject, count(*) FILTER (kind = 'check') AS evaluated, count(act) AS fired, count(*) FILTER (exit = 2) AS blocked, count(*) FILTER (exit = 1) AS warned, any_value(tags) AS tags FROM lg JOIN t USING (subject) GROUP BY 1""")
def _(spark, d):
    return stats.unit_report(action_log(spark, d), journal(spark, d)).withColumn("tags", F.array_join("tags", ","))


@query("a26_nearest_rank", "SELECT event_type, quantile_disc(user_id, 0.5) AS p50, quantile_disc(user_id, 0.95) AS p95 FROM events GROUP BY 1")
def _(spark, d):
    return stats.nearest_rank(table(spark, d, "events"), "user_id", by=["event_type"])


@query("a27_distribution", f"WITH {L} SELECT count(*) AS n, CAST(floor(sum(coalesce(duration, 0)) / count(*)) AS BIGINT) AS mean, quantile_disc(coalesce(duration, 0), 0.5) AS p50, quantile_disc(coalesce(duration, 0), 0.95) AS p95 FROM lg")
def _(spark, d):
    return stats.distribution(action_log(spark, d), "duration_secs")


@query("a27_tallies", f"WITH {J} SELECT tag AS item, count(*) AS n FROM (SELECT tag FROM j UNION ALL SELECT 'big' FROM j WHERE big) GROUP BY 1")
def _(spark, d):
    return stats.tallies(journal(spark, d), "tags")


@query("w20_log_window", f"WITH {J} SELECT count(*) AS n FROM j WHERE ts >= {NOW - 604800}")
def _(spark, d):
    return stats.since(action_log(spark, d), NOW, 604800).agg(F.count("*").alias("n"))


@query("k5_exposition", f"""WITH {L} SELECT 'hook_checks_total{{phase="' || phase || '",tool="' || tool || '"}} ' || count(*) AS line FROM lg WHERE kind = 'check' GROUP BY phase, tool""")
def _(spark, d):
    rows = action_log(spark, d).where("kind = 'check'").groupBy("phase", "tool").agg(F.count("*").alias("n"))
    return stats.exposition(rows, "hook_checks_total", ["phase", "tool"], "n")


# ---------------------------------------------------------------- outcomes

S = f"{J}, sig AS (SELECT subject, tag AS key, seq, CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'fail' END AS status FROM j)"


def signals(spark, d):
    return journal(spark, d).select("subject", F.col("event_type").alias("key"), "seq", F.when(F.col("k") % 2 == 0, "pass").otherwise("fail").alias("status"))


@query("a12_latest_wins", f"WITH {S} SELECT subject, key, arg_max(status, seq) AS status, max(seq) AS seq FROM sig GROUP BY ALL")
def _(spark, d):
    return outcomes.latest(signals(spark, d))


@query("a13_proof_withholding", f"""WITH {S}, l AS (SELECT subject, key, arg_max(status, seq) AS status, max(seq) AS seq FROM sig WHERE key <> 'signup' GROUP BY ALL), m AS (SELECT subject, max(seq) AS marker FROM sig WHERE key = 'signup' GROUP BY 1)
SELECT subject, count(*) FILTER ((marker IS NULL OR seq > marker) AND status = 'pass') AS proved, count(*) AS known, bool_and((marker IS NULL OR seq > marker) AND status = 'pass') AS holds FROM l LEFT JOIN m USING (subject) GROUP BY 1""")
def _(spark, d):
    s = signals(spark, d)
    return outcomes.proofs(s.where("key <> 'signup'"), s.where("key = 'signup'"))


@query("a15_confidence_band", f"""WITH {S}, l AS (SELECT subject, key, arg_max(status, seq) AS status FROM sig GROUP BY ALL), c AS (SELECT subject, count(*) FILTER (status = 'pass') AS n FROM l GROUP BY 1)
SELECT subject, n, CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END AS band FROM c""")
def _(spark, d):
    n = outcomes.latest(signals(spark, d)).groupBy("subject").agg(F.count_if(F.col("status") == "pass").alias("n"))
    return n.withColumn("band", outcomes.band(F.col("n")))


@query("a16_test_summary", f"""WITH {J} SELECT seq, CASE k % 3 WHEN 0 THEN 'pytest' ELSE 'cargo-test' END AS tool, CASE WHEN k % 3 = 2 OR k % 4 <> 0 THEN 'fail' ELSE 'pass' END AS outcome, CASE k % 3 WHEN 0 THEN k WHEN 1 THEN 2 * k ELSE k END AS passed, CASE WHEN k % 3 = 2 THEN 3 ELSE 0 END AS failed FROM j""")
def _(spark, d):
    k = F.col("k")
    told = F.when(k % 3 == 0, F.concat(k, F.lit(" passed in 2s"))).when(k % 3 == 1, F.concat(F.lit("test result: ok. "), k, F.lit(" passed; x\ntest result: ok. "), k, F.lit(" passed"))).otherwise(
        F.concat(F.lit("test result: FAILED. "), k, F.lit(" passed; 3 failed")))
    runs = journal(spark, d).select("seq", F.when(k % 3 == 0, "pytest -q").otherwise("cargo test").alias("command"), told.alias("output"), (k % 4).alias("command_exit"))
    return outcomes.evaluate(runs).select("seq", "tool", "outcome", "passed", "failed")


@query("j35_bug_checks", """WITH t AS (SELECT 't' || p_size AS name, bool_and(p_retailprice >= 905) AS passed FROM part GROUP BY 1), b AS (SELECT 'b' || s_suppkey AS bug_id, 't' || (s_suppkey % 60) AS test FROM supplier WHERE s_acctbal > 0),
r AS (SELECT coalesce(bool_or(NOT passed), false) AS regression FROM t WHERE name NOT IN (SELECT test FROM b))
SELECT bug_id, test, CASE WHEN passed IS NULL THEN 'unknown' WHEN passed THEN 'fixed' ELSE 'open' END AS outcome, regression FROM b LEFT JOIN t ON name = test, r""")
def _(spark, d):
    results = table(spark, d, "part").select(F.concat(F.lit("t"), "p_size").alias("name"), (F.col("p_retailprice") >= 905).alias("passed"))
    bugs = table(spark, d, "supplier").select(F.concat(F.lit("b"), "s_suppkey").alias("bug_id"), F.concat(F.lit("t"), F.col("s_suppkey") % 60).alias("test"), F.when(F.col("s_acctbal") > 0, "open").otherwise("closed").alias("status"))
    return outcomes.bug_checks(bugs, results)


# ---------------------------------------------------------------- graphs

G = """g AS (SELECT 'supplies' AS p, 'nation::n' || s_nationkey || '::s' || s_suppkey AS x, 'n' || s_nationkey AS y, s_suppkey AS ord FROM supplier
  UNION ALL SELECT 'part_of', 'brand::' || p_brand || '::' || p_type || p_partkey, p_type, 1000000 + p_partkey FROM part
  UNION ALL SELECT 'sells', 's' || l_suppkey, 'p' || l_partkey, 10000000 + l_orderkey * 10 + l_linenumber FROM lineitem)"""


def edges(spark, d):
    def of(p, x, y, ord, t):
        return t.select(ord.cast("long").alias("ord"), F.lit(p).alias("p"), F.array(x, y).alias("a"), F.lit("t").alias("src"), F.lit(False).alias("d"))
    s, p, li = (table(spark, d, n) for n in ("supplier", "part", "lineitem"))
    return of("supplies", F.concat(F.lit("nation::n"), "s_nationkey", F.lit("::s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.col("s_suppkey"), s).unionByName(
        of("part_of", F.concat(F.lit("brand::"), "p_brand", F.lit("::"), "p_type", "p_partkey"), F.col("p_type"), F.col("p_partkey") + 1_000_000, p)).unionByName(
        of("sells", F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber") + 10_000_000, li))


@query("p7_pattern_query", f"WITH {G} SELECT ord, p, x || ',' || y AS a FROM g WHERE p = 'sells' AND x = 's7'")
def _(spark, d):
    return graph.query(edges(spark, d), "sells", ["s7"]).select("ord", "p", F.array_join("a", ",").alias("a"))


@query("p8_glob", f"WITH {G} SELECT ord, x AS a0 FROM g WHERE p IN ('supplies', 'part_of') AND x SIMILAR TO '.*::s.7'")
def _(spark, d):
    return graph.query(edges(spark, d), "*p*l*es", ["*::s?7"]).unionByName(graph.query(edges(spark, d), "part_*", ["*::s?7"])).select("ord", F.col("a")[0].alias("a0"))


@query("p9_bare_name", f"WITH {G} SELECT ord, x AS a0 FROM g WHERE p = 'supplies' AND (x = 's11' OR x LIKE '%:s11')")
def _(spark, d):
    return graph.query(edges(spark, d), "supplies", ["s11"]).select("ord", F.col("a")[0].alias("a0"))


@query("p11_total_beside_rows", f"""WITH {G}, m AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY ord) AS r FROM g WHERE p = 'part_of' AND y = 'ECONOMY')
SELECT ord, total, total > 20 AS truncated FROM m WHERE r <= 20""")
def _(spark, d):
    return graph.query_with_total(edges(spark, d), "part_of", ["*", "ECONOMY"], 20).select("ord", "total", "truncated")


@query("a1_relation_summary", f"WITH {G} SELECT p, count(*) AS n FROM g GROUP BY 1")
def _(spark, d):
    return graph.summary(edges(spark, d))


@query("j12_no_direct_test", """SELECT 'p' || p_partkey AS fn FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)""")
def _(spark, d):
    fn = lambda p, a, t: t.select(F.lit(p).alias("p"), F.array(*a).alias("a"))
    e = fn("defines_fn", [F.col("p_brand"), F.concat(F.lit("p"), "p_partkey")], table(spark, d, "part")).unionByName(
        fn("tested_by", [F.concat(F.lit("p"), "l_partkey"), F.col("l_orderkey").cast("string")], table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 7")))
    return graph.no_direct_test(e)


@query("j13_artifact_gaps", """SELECT 'generated_without_consumer' AS p, 'c' || c_custkey AS artifact FROM customer WHERE c_custkey % 5 <> 1 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)
UNION ALL SELECT DISTINCT 'consumed_without_producer', 'c' || o_custkey FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 1)""")
def _(spark, d):
    key = F.substring(F.col("a")[1], 2, 20).cast("long")
    return graph.artifact_gaps(artifacts(spark, d).where(F.when(F.col("p") == "generates", key % 5 != 1).otherwise(key % 3 != 0)))


def artifacts(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.select(F.lit("generates").alias("p"), F.array(F.col("c_nationkey").cast("string"), F.concat(F.lit("c"), "c_custkey")).alias("a")).unionByName(
        o.select(F.when(F.col("o_orderstatus") == "F", "deserializes").otherwise("consumes_data").alias("p"), F.array(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")).alias("a")))


@query("j18_data_flows", "SELECT DISTINCT 'c' || o_custkey AS artifact, 'o' || o_orderkey AS consumer FROM orders")
def _(spark, d):
    return graph.data_flows(artifacts(spark, d))


@query("j14_predicate_flow", "SELECT DISTINCT 's' || l_suppkey AS script, p_type AS predicate, p_brand AS rule FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    emits = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("script"), F.col("l_partkey").alias("predicate"))
    uses = table(spark, d, "part").select(F.col("p_partkey").alias("predicate"), F.col("p_brand").alias("rule"), "p_type")
    return graph.predicate_flow(emits, uses.withColumn("rule", F.concat_ws("|", "p_type", "rule"))).select(
        "script", F.substring_index("rule", "|", 1).alias("predicate"), F.substring_index("rule", "|", -1).alias("rule")).distinct()


@query("j15_unique_match", """WITH n AS (SELECT p_name, count(DISTINCT p_brand) AS n, min(p_brand) AS b FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN n = 1 THEN b END AS p_brand, CASE WHEN n > 1 THEN 'ambiguous' END AS diagnostic FROM part JOIN n USING (p_name)""")
def _(spark, d):
    t = table(spark, d, "part")
    return graph.unique_match(t.select("p_partkey", "p_name"), t.select("p_name", "p_brand"), "p_name", "p_brand").select("p_partkey", "p_brand", "diagnostic")


STEPS = "steps AS (SELECT s_suppkey AS x, (s_suppkey * 2 + 1) % (SELECT count(*) FROM supplier) AS y FROM supplier UNION SELECT s_suppkey, s_suppkey // 2 FROM supplier WHERE s_acctbal > 5000)"


def steps(spark, d):
    s = table(spark, d, "supplier")
    n = s.count()
    return s.select(F.col("s_suppkey").cast("string").alias("x"), ((F.col("s_suppkey") * 2 + 1) % n).cast("string").alias("y")).union(
        s.where("s_acctbal > 5000").select(F.col("s_suppkey").cast("string"), F.expr("s_suppkey div 2").cast("string"))).toDF("x", "y").distinct()


@query("u6_closure", f"""WITH RECURSIVE {STEPS}, r AS (SELECT s_nationkey AS s, s_suppkey AS y FROM supplier UNION SELECT r.s, steps.y FROM r JOIN steps ON r.y = steps.x)
SELECT s AS start, count(*) AS n, sum(y) AS total FROM r GROUP BY 1""")
def _(spark, d):
    starts = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("start"), F.col("s_suppkey").cast("string").alias("node"))
    return graph.closure(starts, steps(spark, d), deep=True).groupBy(F.col("start").cast("int").alias("start")).agg(F.count("*").alias("n"), F.sum(F.col("node").cast("long")).alias("total"))


@query("u7_cycles", f"""WITH RECURSIVE {STEPS}, r AS (SELECT x, y FROM steps UNION SELECT r.x, steps.y FROM r JOIN steps ON r.y = steps.x)
SELECT CAST(a.x AS VARCHAR) AS node, 'cycle:' || string_agg(CAST(a.y AS VARCHAR), '+' ORDER BY CAST(a.y AS VARCHAR)) AS cycle FROM r a JOIN r b ON a.x = b.y AND a.y = b.x GROUP BY a.x""")
def _(spark, d):
    return graph.cycles(steps(spark, d))


@query("u5_compaction", f"WITH {G} SELECT p, count(*) AS n FROM g WHERE p <> 'sells' GROUP BY 1 UNION ALL SELECT 'fresh', 5")
def _(spark, d):
    e = edges(spark, d).withColumn("src", F.col("p"))
    fresh = table(spark, d, "region").select(F.lit("fresh").alias("p"), F.array("r_name").alias("a"), F.lit("sells").alias("src"), F.lit(False).alias("d"))
    return graph.compacted(e, fresh, "sells").groupBy("p").agg(F.count("*").alias("n"))


@query("j32_freshness", """SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM (SELECT c_custkey AS k, c_nationkey AS h FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS h FROM supplier) b ON a.k = b.k WHERE a.h IS DISTINCT FROM b.h""")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("hash"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("hash"))
    return graph.freshness(a, b).select("path", "state")


def bindings(spark, d):
    b = table(spark, d, "part").groupBy(F.col("p_brand").alias("rule"), F.col("p_name").alias("symbol")).agg(F.array_sort(F.collect_set("p_type")).alias("bound_to")).withColumn("stale_at", F.lit(None).cast("int"))
    defs = table(spark, d, "part").where("p_size > 30 AND p_name NOT LIKE 'b%'").select(F.col("p_name").alias("symbol"), F.concat_ws("-", "p_type", F.when(F.col("p_size") > 49, F.lit("x"))).alias("path"))
    return graph.reconcile(b, defs, NOW)


BIND = f"""b AS (SELECT p_brand AS rule, p_name AS symbol, list_sort(list(DISTINCT p_type)) AS bound_to FROM part GROUP BY ALL),
df AS (SELECT p_name AS symbol, list(DISTINCT CASE WHEN p_size > 49 THEN p_type || '-x' ELSE p_type END) AS paths FROM part WHERE p_size > 30 AND p_name NOT LIKE 'b%' GROUP BY 1),
rc AS (SELECT rule, symbol, list_filter(bound_to, lambda t: list_contains(coalesce(paths, []), t)) AS surviving, list_filter(list_sort(coalesce(paths, [])), lambda t: NOT list_contains(bound_to, t)) AS relocated FROM b LEFT JOIN df USING (symbol)),
st AS (SELECT *, CASE WHEN len(surviving) > 0 THEN 'bound' WHEN len(relocated) > 0 THEN 'moved' ELSE 'stale' END AS state FROM rc)"""


@query("j30_reconcile", f"WITH {BIND} SELECT rule, symbol, array_to_string(surviving, ',') AS surviving, array_to_string(relocated, ',') AS relocated, state, CASE WHEN state = 'stale' THEN {NOW} END AS stale_at FROM st")
def _(spark, d):
    return bindings(spark, d).select("rule", "symbol", F.array_join("surviving", ",").alias("surviving"), F.array_join("relocated", ",").alias("relocated"), "state", "stale_at")


@query("j31_stale_rules", f"WITH {BIND} SELECT rule || ':' || symbol[1:4] AS rule, count(*) AS n FROM st GROUP BY 1 HAVING bool_and(state = 'stale')")
def _(spark, d):
    return graph.stale_rules(bindings(spark, d).withColumn("rule", F.concat("rule", F.lit(":"), F.substring("symbol", 1, 4))))


@query("j20_governance", """WITH dec AS (SELECT 'd' || c_custkey AS decision, CASE c_mktsegment WHEN 'BUILDING' THEN 'accepted' WHEN 'MACHINERY' THEN 'proposed' ELSE 'superseded' END AS status, 'r' || c_nationkey AS rule FROM customer), k AS (SELECT 'r' || n_nationkey AS rule FROM nation WHERE n_regionkey < 4),
e AS (SELECT DISTINCT CASE WHEN k.rule IS NULL THEN 'decision_missing_rule' WHEN status = 'accepted' THEN 'rule_governed_by' WHEN status = 'proposed' THEN 'proposed_decision_enforces' ELSE 'superseded_decision_enforces' END AS relation, decision, dec.rule AS rule FROM dec LEFT JOIN k ON dec.rule = k.rule)
SELECT * FROM e UNION ALL SELECT 'rule_without_decision', NULL, rule FROM k WHERE rule NOT IN (SELECT rule FROM e WHERE relation = 'rule_governed_by')""")
def _(spark, d):
    status = F.when(F.col("c_mktsegment") == "BUILDING", "accepted").when(F.col("c_mktsegment") == "MACHINERY", "proposed").otherwise("superseded")
    dec = table(spark, d, "customer").select(F.concat(F.lit("d"), "c_custkey").alias("id"), status.alias("status"), F.array(F.concat(F.lit("r"), "c_nationkey")).alias("enforces"))
    return graph.governance(dec, table(spark, d, "nation").where("n_regionkey < 4").select(F.concat(F.lit("r"), "n_nationkey").alias("id")))


@query("j27_lexical_pairs", """SELECT a.l_orderkey AS fn, a.l_linenumber AS "left", b.l_linenumber AS "right" FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'A' AND a.l_linenumber < b.l_linenumber""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    site = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("at"))
    return graph.lexical_pairs(site("R"), site("A"))


# ---------------------------------------------------------------- coverage

LINES = "li AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, l_linenumber * 50 + CAST(l_quantity AS BIGINT) AS line, l_orderkey AS change FROM lineitem), sp AS (SELECT CAST(p_partkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS file, 'fn' || p_partkey AS region, p_size * 8 AS s, p_size * 8 + 5 AS e FROM part)"


def lines_and_spans(spark, d):
    n = table(spark, d, "supplier").count()
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("file"), (F.col("l_linenumber") * 50 + F.col("l_quantity").cast("long")).alias("line"), F.col("l_orderkey").alias("change"))
    sp = table(spark, d, "part").select((F.col("p_partkey") % n).cast("string").alias("file"), F.concat(F.lit("fn"), "p_partkey").alias("region"), (F.col("p_size") * 8).cast("long").alias("start"), (F.col("p_size") * 8 + 5).cast("long").alias("end"))
    return li, sp


@query("j26_changed_regions", f"WITH {LINES} SELECT DISTINCT change, region FROM li JOIN sp ON li.file = sp.file AND line BETWEEN s AND e")
def _(spark, d):
    return coverage.changed_regions(*lines_and_spans(spark, d))


@query("j24_gaps", f"""WITH {LINES} SELECT region FROM sp WHERE region NOT IN (SELECT region FROM li JOIN sp ON li.file = sp.file AND line BETWEEN s AND e)""")
def _(spark, d):
    li, sp = lines_and_spans(spark, d)
    return coverage.gaps(sp, coverage.changed_regions(li, sp))


@query("j22_dynamic_selection", f"""WITH {LINES}, h AS (SELECT 't' || change AS test, region FROM (SELECT DISTINCT change, region FROM li JOIN sp ON li.file = sp.file AND line BETWEEN s AND e) UNION ALL SELECT 'whole', 'file:7'),
c AS (SELECT region, file FROM sp WHERE s > 200)
SELECT DISTINCT test, region FROM h JOIN c USING (region) UNION SELECT 'whole', region FROM c WHERE file = '7'""")
def _(spark, d):
    li, sp = lines_and_spans(spark, d)
    hits = coverage.changed_regions(li, sp).select(F.concat(F.lit("t"), "change").alias("test"), "region").unionByName(spark.createDataFrame([("whole", "file:7")], "test string, region string"))
    return coverage.select_dynamic(sp.where("start > 200"), hits)


@query("u2_set_changes", """WITH o AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem WHERE l_linestatus = 'F'), n AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem WHERE l_linestatus = 'O')
SELECT k, i, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT k, i, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("i"), "l_linestatus")
    return coverage.set_changes(li.where("l_linestatus = 'F'").drop("l_linestatus"), li.where("l_linestatus = 'O'").drop("l_linestatus"), "k", "i")


@query("a19_increased", """WITH n AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT k, n FROM n LEFT JOIN b USING (k) WHERE n > coalesce(m, 0)""")
def _(spark, d):
    count = lambda f: table(spark, d, "lineitem").where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    return audit.increased(count("R"), count("A"), ["k"], "n")


# ---------------------------------------------------------------- audits, detection, drift

RULES = [("pipe", "block", "|", None, None, None), ("the", "warn", "the", "src1", None, None), ("stop", "warn", ".", None, "txt", 5), ("all", "block", None, "src3", None, 40)]
FILES = """f AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.md' END AS file, text, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT 'pipe' AS rule_id, 'block' AS level, file, length(text) - length(replace(text, '|', '')) AS hits FROM f
  UNION ALL SELECT 'the', 'warn', file, (length(text) - length(replace(text, 'the', ''))) // 3 FROM f WHERE contains(file, 'src1')
  UNION ALL SELECT 'stop', 'warn', file, length(text) - length(replace(text, '.', '')) FROM f WHERE file LIKE '%.txt' AND n_lines > 5
  UNION ALL SELECT 'all', 'block', file, 1 FROM f WHERE contains(file, 'src3') AND n_lines > 40)"""


def files(spark, d):
    t = spread(table(spark, d, "documents")).where("text IS NOT NULL")
    return t.select(F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".md")).alias("file"), "text")


@query("d1_audit_hits", f"WITH {FILES} SELECT rule_id, level, file, hits FROM h WHERE hits > 0")
def _(spark, d):
    return audit.hit_counts(files(spark, d), [audit.ContentRule(*r) for r in RULES])


@query("d1_audit_lines", r"""WITH f AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT file, line_no, length(line) - length(replace(line, '|', '')) AS n FROM f WHERE contains(line, '|')""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return audit.hits(docs, [audit.ContentRule("pipe", "block", "|")]).groupBy(F.col("file").cast("long").alias("file"), "line_no").agg(F.count("*").alias("n"))


@query("a17_audit_rollup", f"""WITH {FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY hits DESC, file) AS rn FROM h WHERE hits > 0)
SELECT rule_id, level, sum(hits) AS hits, count(*) AS files, string_agg(CASE WHEN rn <= 3 THEN file END, ',' ORDER BY rn) AS offenders FROM r GROUP BY ALL""")
def _(spark, d):
    counts = audit.hit_counts(files(spark, d), [audit.ContentRule(*r) for r in RULES])
    return audit.rollup(counts).withColumn("offenders", F.array_join("offenders", ","))


@query("p18_missing_patterns", "SELECT doc_id AS file, p AS pattern FROM documents, (VALUES ('the'), ('License'), ('|')) t(p) WHERE text IS NOT NULL AND NOT contains(text, p)")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    return audit.missing(docs, ["the", "License", "|"])


@query("p15_path_facts", r"""WITH u AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS file FROM pages), s AS (SELECT file, list_filter(string_split(file, '/'), lambda x: x <> '') AS l FROM u)
SELECT file, 'file_path_matches' AS predicate, unnest(list_distinct(l)) AS value FROM s UNION SELECT file, 'project_path_is', array_to_string(l, '/') FROM s
UNION SELECT file, 'project_path_under', unnest(list_transform(range(1, len(l)), lambda i: array_to_string(l[1:i], '/'))) FROM s
UNION SELECT file, 'file_extension_is', lower(regexp_extract(file, '\.([^./]+)$', 1)) FROM s WHERE regexp_extract(file, '\.([^./]+)$', 1) <> ''""")
def _(spark, d):
    return audit.path_facts(table(spark, d, "pages").select(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("file")).distinct())


@query("p20_module_resolve", r"""SELECT page_id, CASE WHEN url SIMILAR TO 'https://blog[.].*' THEN 'blog' WHEN url SIMILAR TO '[^/]*//[^/]*/en/[^/]*' THEN 'english' WHEN url SIMILAR TO '.*[.]html' THEN 'html' END AS module FROM pages""")
def _(spark, d):
    modules = [("blog", ["https://blog.**"]), ("english", ["*//*/en/*"]), ("html", ["**.html"])]
    return table(spark, d, "pages").select("page_id", journey.module_of(F.col("url"), modules).alias("module"))


@query("x_detectors", r"""WITH f AS (SELECT doc_id, unnest(list_concat(
  list_transform(regexp_extract_all(text, '(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|refresh[_-]?token|client[_-]?secret|secret[_-]?key|private[_-]?key|password|passwd)["''\\]{0,4}\s*[:=]\s*["''\\]{0,4}[A-Za-z0-9+/_.\-]{8,}'), lambda m: {'what': 'token/secret assignment', 'm': m}),
  list_transform(regexp_extract_all(text, '-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----'), lambda m: {'what': 'private-key header', 'm': m}),
  list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9+.\-]{0,15}://[^/\s:@"'',]{0,64}:[^@\s"'',]{1,256}@'), lambda m: {'what': 'credential-bearing URL', 'm': m}),
  list_transform(regexp_extract_all(text, '(?i)\bbearer(?:\s+|:\s*)[A-Za-z0-9\-._~+/]{16,}'), lambda m: {'what': 'bearer token', 'm': m}),
  list_transform(regexp_extract_all(text, '\b[A-Z][A-Z0-9_]{2,40}(?:TOKEN|SECRET|PASSWORD|APIKEY|API_KEY|PRIVATE_KEY|CREDENTIALS)["''\\]{0,4}\s*[:=]\s*["''\\]{0,4}\S{4,}'), lambda m: {'what': 'secret-suggesting environment key', 'm': m}),
  list_transform(list_filter(regexp_extract_all(text, '(?:^|file://|\\[ntr]|[^\p{L}\p{N}/.~])(/[A-Za-z0-9._+\-]+(?:/[A-Za-z0-9._+\-]+)+)', 1),
    lambda m: NOT regexp_matches(m, '^/(?:usr|bin|sbin|etc|opt|lib|lib64|dev|proc|sys|run|System|Library)(?:/|$)')), lambda m: {'what': 'absolute path outside the project placeholder roots', 'm': m}),
  list_transform(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,128}\.[A-Za-z]{2,24}\b'), lambda m: {'what': 'email address', 'm': m}))) AS r FROM documents)
SELECT doc_id, r.what AS what, CASE WHEN r.what = 'email address' OR (r.what IN ('token/secret assignment', 'bearer token', 'secret-suggesting environment key') AND NOT regexp_matches(r.m, '[0-9]')) THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM f GROUP BY ALL""")
def _(spark, d):
    return scrub.findings(spread(table(spark, d, "documents").select("doc_id", "text"))).groupBy("doc_id", "what", "severity").agg(F.count("*").alias("n"))


@query("x_token_sets", r"""SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'),
  lambda w: strlen(w) > 1 AND w NOT IN ('the','a','an','of','to','for','in','on','at','by','is','are','be','and','or','but','with','as','it','its','this','that','you','your','we','our','i','me')))) AS n FROM documents""")
def _(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))


@query("j36_best_match", r"""WITH st(w) AS (SELECT unnest(['the','a','an','of','to','for','in','on','at','by','is','are','be','and','or','but','with','as','it','its','this','that','you','your','we','our','i','me'])),
a AS (SELECT DISTINCT conv_id, turn, w FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+')) AS w FROM conversations) WHERE strlen(w) > 1 AND w NOT IN (SELECT w FROM st)),
b AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE strlen(w) > 1 AND w NOT IN (SELECT w FROM st)),
an AS (SELECT conv_id, turn, count(*) AS n FROM a GROUP BY ALL), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT conv_id, turn, item_id, count(*) AS shared FROM a JOIN b USING (w) GROUP BY ALL),
x AS (SELECT s.*, an.n + bn.n - shared AS u, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CAST(shared / (an.n + bn.n - shared) AS FLOAT) DESC, item_id) AS r FROM s JOIN an USING (conv_id, turn) JOIN bn USING (item_id))
SELECT conv_id || '-' || turn AS id, item_id AS target, shared, u AS "union" FROM x WHERE r = 1""")
def _(spark, d):
    left = spread(table(spark, d, "conversations")).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    right = table(spark, d, "benchmark").select(F.col("item_id").alias("target"), F.col("item_id").alias("ord"), "text")
    return drift.best_match(left, right).select("id", "target", "shared", "union")


@query("o5_triage", """WITH i AS (SELECT doc_id AS ord, source AS family, lang <> 'en' AS personal FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY family DESC, personal, ord) AS r, count(*) OVER () AS total FROM i)
SELECT ord, family, total, total > 40 AS truncated FROM r WHERE r <= 40""")
def _(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("family"), (F.col("lang") != "en").alias("personal"))
    return drift.triage(items, 40).select("ord", "family", "total", "truncated")


del _

from . import catalog_wide as _wide  # noqa: E402,F401  registers the rest
