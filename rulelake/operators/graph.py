"""A graph of typed relations: edges (ord, p, a array, src, d) and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import leaf, names


def pattern(relation: str, args: Sequence[str]) -> Column:
    """Relation and leading arguments match; arguments beyond those given are free, missing ones never match."""
    from ..functions.text import glob

    hit = glob(F.col("p"), relation) if any(c in relation for c in "*?") else F.col("p") == relation
    hit = hit & (F.size("a") >= len(args))
    for i, a in enumerate(args):
        if a != "*":
            hit = hit & names(F.try_element_at("a", F.lit(i + 1)), a)
    return F.coalesce(hit, F.lit(False))


def matching(edges: DataFrame, relation: str, args: Sequence[str] = ()) -> DataFrame:
    """Edges that the pattern matches; from a stored layout only the row groups that can hold them are read."""
    from ..sources import layout

    if not any(c in relation for c in "*?"):
        edges = edges.where(F.col("p") == relation)  # as it stands, a reader can skip by it
        if layout.FIRST in edges.columns and args and args[0] != "*" and (first := layout.first_named(args[0])) is not None:
            edges = edges.where(first)
    return edges.where(pattern(relation, args))


def query(edges: DataFrame, relation: str, args: Sequence[str] = (), limit: int = 0) -> DataFrame:
    """Matching edges in stored order; limit 0 is no limit."""
    found = matching(edges, relation, args).orderBy("ord")
    return found.limit(limit) if limit else found


def query_with_total(edges: DataFrame, relation: str, args: Sequence[str], limit: int) -> DataFrame:
    """The first edges, with how many there are and whether that is more."""
    found = matching(edges, relation, args)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("ord").limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p")


def diagnose(edges: DataFrame, relation: str, args: Sequence[str] = ()) -> dict:
    """Why a query found nothing: an empty graph, an unknown relation (with suggestions) or arguments that do not
    occur (with samples)."""
    if edges.isEmpty():
        return {"reason": "empty_graph"}
    if not edges.where(pattern(relation, args)).isEmpty():
        return {"reason": "matches"}
    if any(c in relation for c in "*?"):
        return {"reason": "wildcard"}
    own = edges.where(F.col("p") == relation)
    if own.isEmpty():
        near = summary(edges.where(F.col("p").contains(relation) | F.lit(relation).contains(F.col("p"))))
        near = near if not near.isEmpty() else summary(edges)
        return {"reason": "unknown_relation", "suggestions": [r.p for r in near.limit(5).collect()]}
    out: dict = {"reason": "no_argument_match", "samples": {}}
    for i, a in enumerate(args):
        value = F.try_element_at("a", F.lit(i + 1))
        if a != "*" and own.where(F.coalesce(names(value, a), F.lit(False))).isEmpty():
            some = own.select(value.alias("v")).where("v IS NOT NULL").distinct()
            near = some.where(F.col("v").contains(a))
            out["samples"][i] = [r.v for r in (near if not near.isEmpty() else some).orderBy("v").limit(3).collect()]
    return out


def base(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("d"))


def pairs(edges: DataFrame, *relations: str, of: Sequence[str] = ("x", "y"), once: bool = True) -> DataFrame:
    """Relations of so many arguments as rows, distinct ones if once."""
    rows = edges.where(F.col("p").isin(*relations) & (F.size("a") == len(of)))
    rows = rows.select(*[F.col("a")[i].alias(c) for i, c in enumerate(of)])
    return rows.distinct() if once else rows


def derived(rows: DataFrame, relation: str, columns: Sequence[str], src: str | None = None) -> DataFrame:
    return rows.select(F.lit(relation).alias("p"), F.array(*columns).alias("a"), F.lit(src).cast("string").alias("src"), F.lit(True).alias("d")).dropDuplicates(["p", "a"])


def no_direct_test(edges: DataFrame) -> DataFrame:
    """Functions without a test of their own; only those of production files, if any file is marked so."""
    defined = pairs(edges, "defines_fn", of=("file", "fn"))
    production = pairs(edges, "file_type", of=("file", "kind")).where("kind = 'production'").select("file")
    if not production.isEmpty():
        defined = defined.join(production, "file", "left_semi")
    return defined.select("fn").distinct().join(pairs(edges, "tested_by", of=("fn", "test")), "fn", "left_anti")


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the left that the right lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def artifact_gaps(edges: DataFrame) -> DataFrame:
    """Artifacts generated without a consumer, and consumed without a producer."""
    made = pairs(edges, "generates", of=("who", "artifact"))
    used = pairs(edges, "consumes_data", "deserializes", of=("who", "artifact"))
    return without(made, used, "artifact").select(F.lit("generated_without_consumer").alias("p"), "artifact").unionByName(
        without(used, made, "artifact").select(F.lit("consumed_without_producer").alias("p"), "artifact"))


def predicate_flow(emits: DataFrame, uses: DataFrame) -> DataFrame:
    """(script, predicate, rule) where a script emits what a rule uses."""
    return emits.join(uses, "predicate").select("script", "predicate", "rule").distinct()


def unique_match(asked: DataFrame, candidates: DataFrame, key: str, target: str) -> DataFrame:
    """asked rows with their candidate if there is exactly one; several give a diagnostic, none gives nothing."""
    by_key = candidates.select(key, target).distinct().groupBy(key).agg(F.count("*").alias("n"), F.min(target).alias(target))
    return asked.join(by_key, key).withColumns({
        target: F.when(F.col("n") == 1, F.col(target)), "diagnostic": F.when(F.col("n") > 1, "ambiguous")}).drop("n")


def inventory(edges: DataFrame) -> DataFrame:
    """(kind, member, module): functions and tests by the module of their file."""
    modules = pairs(edges, "declares_module", of=("file", "module"))
    rows = [pairs(edges, relation, of=("file", "member")).join(modules, "file").select(F.lit(kind).alias("kind"), "member", "module")
            for relation, kind in (("defines_fn", "function"), ("defines_method", "function"), ("defines_test", "test"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).distinct()


def data_flows(edges: DataFrame) -> DataFrame:
    """(artifact, consumer)."""
    return pairs(edges, "consumes_data", "deserializes", of=("consumer", "artifact")).select("artifact", "consumer").distinct()


#: Starts whose reach one number of a closure's state holds, numbers of one row, and rows beyond which the graph is reduced
#: to its strongly connected sets first.
LANES, WORDS, STATE_ROWS = 64, 8, 1_000_000


def unique_steps(steps: DataFrame) -> DataFrame:
    """(node, to) for nodes with one step (x, y) to another node."""
    return steps.where("x <> y").groupBy(F.col("x").alias("node")).agg(F.min("y").alias("to"), F.max("y").alias("most")).where("to = most").select("node", "to")


def doubled(jumps: DataFrame) -> DataFrame:
    """Jumps (node, to) twice as long; those that end where no jump begins stay."""
    return jumps.join(jumps.select(F.col("node").alias("to"), F.col("to").alias("beyond")), "to", "left").select("node", F.coalesce("beyond", "to").alias("to"))


def reach(starts: DataFrame, steps: DataFrame, stop: DataFrame | None = None, deep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What closure and reach_sizes tell from: the state (node, block, b0, b1, ...), the starts by the block and place of their
    bit, and (node, set) of nodes that one node of the state stands for, if there are such."""
    from ..plans.tables import Held, numbered, small

    first = starts.select("start", F.col("start").alias("node")).distinct() if "node" not in starts.columns else starts.select("start", "node").distinct()
    if stop is not None:  # a stop node leads nowhere
        steps = steps.join(stop.select(F.col(stop.columns[0]).alias("x")), "x", "left_anti")
    called = Held(steps.select(F.col("y").alias("x")).distinct())
    asked = first.select(F.col("node").alias("x")).unionByName(called.df).distinct()  # no other node's steps are ever taken
    hop, sets = Held(steps.select("x", "y").join(asked, "x", "left_semi").distinct()), None
    if not deep and called.df.count() * -(-first.select("start").distinct().count() // (LANES * WORDS)) > STATE_ROWS:
        ids, told = strong(hop.df.join(called.df, "x", "left_semi"))
        members = told.join(ids, "id").select("node", "c")
        named = members.groupBy("c").agg(F.min("node").alias("set"), F.count("*").alias("n")).where("n > 1")
        sets = Held(members.join(named, "c").select("node", "set")).df
        of = lambda rows, c: rows.join(small(sets.select(F.col("node").alias(c), "set")), c, "left").withColumn(c, F.coalesce("set", c)).drop("set")
        hop.become(of(of(hop.df, "x"), "y").where("x <> y").select("x", "y").distinct())
        called.become(of(called.df, "x").distinct())
        first = of(first, "node").distinct()
    # starts with a next node in common reach much the same and get numbers side by side, so that a row tells of many
    near = first.join(hop.df.select(F.col("x").alias("node"), "y"), "node", "left").groupBy("start").agg(F.concat_ws("\0", F.coalesce(F.min("y"), F.lit("")), F.col("start").cast("string")).alias("__place"))
    index = Held(numbered(near, "__place", "n").drop("__place"))
    words = [f"b{i}" for i in range(WORDS)]
    one = [F.expr(f"IF(n div {LANES} % {WORDS} = {i}, shiftleft(1L, CAST(n % {LANES} AS INT)), 0L)") for i in range(WORDS)]
    block = F.expr(f"n div {LANES * WORDS}").alias("block")
    reached = Held(first.join(index.df, "start").groupBy("node", block).agg(*[F.bit_or(c).alias(w) for w, c in zip(words, one)]))

    def along(bits: DataFrame, by: DataFrame) -> DataFrame:
        return bits.join(by.select(F.col("x").alias("node"), "y"), "node").select(F.col("y").alias("node"), "block", *words)

    def summed(bits: DataFrame) -> DataFrame:
        return bits.groupBy("node", "block").agg(*[F.bit_or(w).alias(w) for w in words])

    if deep and stop is None:
        jumps, told = Held(unique_steps(hop.df.select(F.col("y").alias("x"), F.col("x").alias("y")))), None
        while True:
            back = jumps.df.select(F.col("to").alias("x"), F.col("node").alias("y"))
            reached.become(summed(reached.df.unionByName(along(reached.df, hop.df.unionByName(back)))))
            now = reached.df.agg(F.count("*"), F.sum(F.xxhash64("node", "block", *words) % 1_000_003)).first()
            if now == told:
                break
            told = now
            jumps.become(doubled(jumps.df))
        jumps.drop()
    else:
        delta, inner = Held(reached.df), Held(hop.df.join(called.df, "x", "left_semi"))  # after the first step only what is called goes on
        ways = hop
        while True:
            old = reached.df.select("node", "block", *[F.col(w).alias(f"old_{w}") for w in words])
            new = summed(along(delta.df, ways.df)).join(old, ["node", "block"], "left").select("node", "block", *[F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"old_{w}", F.lit(0).cast("long")))).alias(w) for w in words])
            delta.become(new.where(" OR ".join(f"{w} <> 0" for w in words)))
            if delta.df.isEmpty():
                break
            reached.become(summed(reached.df.unionByName(delta.df)))
            ways = inner
        delta.drop()
        inner.drop()
    hop.drop()
    called.drop()
    held = index.df.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"CAST(n % {LANES * WORDS} AS INT)"), "start"))).alias("starts"))  # LANES * WORDS at most
    return reached.df, held, sets


def lanes() -> Column:
    """Array of the places whose bits a row of the state of reach has set."""
    inside = lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.call_function("getbit", f"b{w}", i) == 1), lambda i: i + w * LANES)
    return F.concat(*[F.when(F.col(f"b{w}") == 0, F.array().cast("array<int>")).otherwise(inside(w)) for w in range(WORDS)])


def closure(starts: DataFrame, steps: DataFrame, stop: DataFrame | None = None, include_start: bool = True, deep: bool = False) -> DataFrame:
    """(start, node) reached by steps (x, y); stop nodes are reached but not passed.

    Starts are numbered, and LANES * WORDS of them share a row: the state is a row for each node and block of starts, whose
    bits tell which of them reach it. A round carries only new bits along the steps, and is written to the shared folder.
    Where that state may be large, a strongly connected set is one node of it. deep (without stop nodes): for long paths,
    all bits also jump along chains (nodes with one way in), and jumps double.
    """
    from ..plans.tables import small

    state, held, sets = reach(starts, steps, stop, deep)
    out = state.join(small(held), "block").select(F.explode(F.transform(lanes(), lambda i: F.try_element_at("starts", i))).alias("start"), "node")  # rows of bits are joined, not what they tell
    if sets is not None:
        out = out.join(small(sets.select(F.col("node").alias("member"), F.col("set").alias("node"))), "node", "left").select("start", F.coalesce("member", "node").alias("node"))
    return out if include_start else out.where("start <> node")


def reach_sizes(starts: DataFrame, steps: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(start, n): how many nodes closure tells for a start, added up by the sizes of strongly connected sets."""
    from ..plans.tables import small

    state, held, sets = reach(starts, steps, stop)
    if sets is not None:
        state = state.join(small(sets.groupBy(F.col("set").alias("node")).agg(F.count("*").alias("n"))), "node", "left")
    counted = state.select("block", F.explode(lanes()).alias("place"), F.coalesce("n", F.lit(1)).alias("n") if sets is not None else F.lit(1).alias("n"))
    sums = counted.groupBy("block", "place").agg(F.sum("n").alias("n"))
    return sums.join(held.select("block", F.explode("starts").alias("place", "start")), ["block", "place"]).select("start", "n")


def _tested(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    tests = pairs(edges, "defines_test", of=("file", "test")).select(F.col("test").alias("start"))
    mains = pairs(edges, "cargo_bin", of=("package", "name", "target")).select(F.concat("target", F.lit("::main")).alias("node"))
    return tests, pairs(edges, "calls", once=False), mains


def test_reaches(edges: DataFrame) -> DataFrame:
    """(test, fn): everything a test calls, itself included, up to and with the entry points of programs."""
    return closure(*_tested(edges)).select(F.col("start").alias("test"), F.col("node").alias("fn"))


def test_reach_sizes(edges: DataFrame) -> DataFrame:
    """(test, n): how many rows test_reaches has for a test."""
    return reach_sizes(*_tested(edges)).select(F.col("start").alias("test"), "n")


def bin_reaches(edges: DataFrame) -> DataFrame:
    """(main, fn): what a program's entry point calls, without itself."""
    mains = pairs(edges, "cargo_bin", of=("package", "name", "target")).select(F.concat("target", F.lit("::main")).alias("start")).distinct()
    return closure(mains, pairs(edges, "calls"), None, include_start=False).select(F.col("start").alias("main"), F.col("node").alias("fn"))


#: Steps whose strongly connected sets one task tells by itself.
SET_STEPS = 20_000


def connected_sets(steps: Sequence[tuple]) -> dict:
    """The least member of its strongly connected set for each node of steps (x, y) whose set has several members (Tarjan,
    without recursion)."""
    to = {}
    for x, y in steps:
        to.setdefault(x, []).append(y)
    at, low, path, out = {}, {}, [], {}
    for first in to:
        if first in at:
            continue
        at[first] = low[first] = len(at)
        path.append(first)
        work = [(first, iter(to[first]))]
        while work:
            x, ways = work[-1]
            for y in ways:
                if y not in at:
                    at[y] = low[y] = len(at)
                    path.append(y)
                    work.append((y, iter(to.get(y, ()))))
                    break
                if low[y] >= 0:  # on the path
                    low[x] = min(low[x], at[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == at[x]:
                    group = [path.pop()]
                    while group[-1] != x:
                        group.append(path.pop())
                    least = min(group)
                    for y in group:
                        low[y] = -1
                        if len(group) > 1:
                            out[y] = least
    return out


def sets_inside(classes: DataFrame, n: int) -> DataFrame:
    """(node, c) for n steps (x, y, k) that fall into classes k of SET_STEPS at most: a task takes classes of about so many
    steps, and each set lies inside one class."""
    import pandas as pd

    def run(pdf):
        found = connected_sets(list(zip(pdf["x"].tolist(), pdf["y"].tolist())))
        return pd.DataFrame({"node": list(found), "c": list(found.values())}, dtype="int64")
    parts = max(1, -(-n // SET_STEPS))
    return classes.withColumn("__part", F.pmod(F.xxhash64("k"), F.lit(parts))).groupBy("__part").applyInPandas(run, "node long, c long")


def colours(steps: DataFrame, turn: int) -> DataFrame:
    """(node, f, b) for steps (x, y) of numbers: of all nodes that a node reaches, and of all that reach it, the first in an
    order of this turn; itself counts. A round takes them over from the next nodes and from the nodes that f and b name."""
    from ..plans.tables import Held

    key = lambda c: F.col(c).bitwiseXOR(F.lit(turn))  # noqa: E731  an order of its own for each turn
    ways = Held(steps.select(key("x").alias("node"), key("y").alias("at"), F.lit(True).alias("out")).unionByName(steps.select(key("y").alias("node"), key("x").alias("at"), F.lit(False).alias("out"))))
    state, told = Held(ways.df.select("node").distinct().select("node", F.col("node").alias("f"), F.col("node").alias("b"))), None
    while True:
        now = state.df
        jumps = [now.where(f"{c} <> node").select("node", F.col(c).alias("at"), F.lit(c == "f").alias("out")) for c in "fb"]
        met = reduce(DataFrame.unionByName, [ways.df, *jumps]).join(now.select(F.col("node").alias("at"), "f", "b"), "at")
        state.become(now.unionByName(met.select("node", F.when(F.col("out"), F.col("f")).alias("f"), F.when(~F.col("out"), F.col("b")).alias("b"))).groupBy("node").agg(F.min("f").alias("f"), F.min("b").alias("b")))
        fresh = state.df.agg(F.sum("f"), F.sum("b")).first()  # they only go down
        if fresh == told:
            ways.drop()
            return state.df.select(*[key(c).alias(c) for c in ("node", "f", "b")])
        told = fresh


def merged(steps: DataFrame, order) -> DataFrame:
    """(node, k) for steps (x, y) of numbers without loops: classes so that a strongly connected set lies inside one.

    A node with one way out is on a circle only with the next node, one with one way in only with the one before: it
    merges with that node if this comes first in an order of the round, so that what merges is a tree. Nodes without a
    way in or out leave. What is left of the steps goes down round by round; a rest that one task can take is told there,
    and one that goes down no more is coloured."""
    from ..plans.tables import Held

    rest, rounds, was = Held(steps.select("x", "y").distinct()), [], None
    n = rest.df.count()
    while n > SET_STEPS and (was is None or n < 0.8 * was):
        key, turn = lambda c: F.col(c).bitwiseXOR(F.lit(turn)), order()  # noqa: E731, B023
        sides = rest.df.select(F.col("x").alias("node"), F.col("y").alias("next"), F.lit(None).cast("long").alias("prior")).unionByName(rest.df.select(F.col("y").alias("node"), F.lit(None).cast("long").alias("next"), F.col("x").alias("prior")))
        ways = sides.groupBy("node").agg(F.count("next").alias("outs"), F.count("prior").alias("ins"), F.min("next").alias("next"), F.min("prior").alias("prior"))
        over = (F.col("outs") == 0) | (F.col("ins") == 0)
        to = F.when(over, F.col("node")).when((F.col("outs") == 1) & (key("next") < key("node")), F.col("next")).when((F.col("ins") == 1) & (key("prior") < key("node")), F.col("prior")).otherwise(F.col("node"))
        moves = Held(ways.select("node", to.alias("to"), over.alias("over"), F.lit(True).alias("more")))
        while True:  # trees are a few nodes deep
            once = moves.df.join(moves.df.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("over").alias("ended")), "to").select("node", F.col("further").alias("to"), F.col("ended").alias("over"))
            twice = once.join(once.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("over").alias("ended")), "to").select("node", F.col("further").alias("to"), F.col("ended").alias("over"), (F.col("further") != F.col("to")).alias("more"))
            if moves.become(twice).where("more").isEmpty():
                break
        end = lambda c: moves.df.select(F.col("node").alias(c), F.col("to").alias(f"__{c}"), F.col("over").alias(f"__over_{c}"))  # noqa: E731, B023
        rest.become(rest.df.join(end("x"), "x").join(end("y"), "y").where("NOT __over_x AND NOT __over_y AND __x <> __y").select(F.col("__x").alias("x"), F.col("__y").alias("y")).distinct())
        rounds.append(moves)
        n, was = rest.df.count(), n
        if len(rounds) == 1 and n >= 0.8 * was:  # hardly anything merges
            return Held(steps.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("k", F.lit("all"))).df
    classes = steps.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("to", F.col("node"))
    for moves in rounds:
        moved = moves.df.where("to <> node").select(F.col("node").alias("to"), F.col("to").alias("further"))
        classes = classes.join(moved, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    if n <= SET_STEPS:
        left = sets_inside(rest.df.withColumn("k", F.lit(0)), n).select(F.col("node").alias("to"), F.concat(F.lit("c"), "c").alias("c"))
    else:
        left = colours(rest.df, order()).select(F.col("node").alias("to"), F.concat_ws(":", F.lit("c"), "f", "b").alias("c"))
    return Held(classes.join(left, "to", "left").select("node", F.coalesce("c", F.col("to").cast("string")).alias("k"))).df


def strong(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of steps (x, y) numbered (node, id), and (id, c) for those whose strongly connected set may have several members.

    Steps inside the classes of merged are all that matter. Small classes are told by tasks that take many of them; a
    larger one is coloured: nodes whose two colours are one node are its set, the others fall into classes by their
    colours, and so on."""
    from random import Random

    from ..plans.tables import Held, numbered

    hop = Held(steps.where("x <> y").select("x", "y").distinct())
    nodes = hop.df.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("__place", F.concat(F.hex(F.xxhash64("node")), F.lit(" "), F.col("node").cast("string")))
    ids = Held(numbered(nodes, "__place", "id").select("node", "id")).df  # in an order that has nothing to do with steps
    bits, random = max(1, ids.count().bit_length()), Random(7)
    order = lambda: random.getrandbits(bits)
    hop.become(hop.df.join(ids.select(F.col("node").alias("x"), F.col("id").alias("__x")), "x").join(ids.select(F.col("node").alias("y"), F.col("id").alias("__y")), "y").select(F.col("__x").alias("x"), F.col("__y").alias("y")))

    def inside(rows: DataFrame, classes: DataFrame) -> DataFrame:
        return rows.select("x", "y").join(classes.select(F.col("node").alias("x"), "k"), "x").join(classes.select(F.col("node").alias("y"), F.col("k").alias("__k")), "y").where("k = __k").select("x", "y", "k")

    left, found = Held(inside(hop.df, merged(hop.df, order))), []
    while True:
        sizes = left.df.groupBy("k").agg(F.count("*").alias("n"))
        n, most = sizes.agg(F.sum("n"), F.max("n")).first()
        if not n:
            break
        large = sizes.where(F.col("n") > SET_STEPS).select("k")
        found.append(Held(sets_inside(left.df.join(large, "k", "left_anti") if most > SET_STEPS else left.df, n)).df)
        if most <= SET_STEPS:
            break
        left.become(left.df.join(large, "k", "left_semi"))
        told = colours(left.df, order())
        found.append(Held(told.where("f = b").select("node", F.col("f").alias("c"))).df)
        left.become(inside(left.df, told.where("f <> b").select("node", F.concat_ws(":", "f", "b").alias("k"))))
    hop.drop()
    left.drop()
    none = ids.limit(0).select(F.col("id").alias("node"), F.col("id").alias("c"))
    return ids, reduce(DataFrame.unionByName, found, none).select(F.col("node").alias("id"), "c")


def cycles(steps: DataFrame) -> DataFrame:
    """(node, cycle): members of each strongly connected set (a self-loop counts), named by its sorted members.

    State is one row a node, however large a set is; chains and rings merge in logarithmic rounds.
    """
    from ..plans.tables import Held, small

    ids, sets = strong(steps)
    members = Held(sets.join(ids, "id").select("node", "c")).df
    named = Held(members.groupBy("c").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("node")), "+").alias("all")).where("n > 1").select("c", F.concat(F.lit("cycle:"), "all").alias("cycle")))
    # a set's name is as long as the set, so it meets the members where they are and is in no shuffle
    several = members.join(small(named.df), "c").select("node", "cycle")
    loops = steps.where("x = y").select(F.col("x").alias("node")).distinct()
    return several.unionByName(loops.join(several.select("node"), "node", "left_anti").select("node", F.concat(F.lit("cycle:"), "node").alias("cycle")))


def compacted(edges: DataFrame, fresh: DataFrame, file: str) -> DataFrame:
    """Without derived edges and those of the file, with its fresh base edges."""
    kept = edges.where(~F.col("d") & ~F.col("src").eqNullSafe(F.lit(file)))
    return kept.unionByName(fresh, allowMissingColumns=True)


def freshness(index: DataFrame, disk: DataFrame) -> DataFrame:
    """Paths whose hashes differ or that one side lacks."""
    both = index.select("path", F.col("hash").alias("was")).join(disk.select("path", F.col("hash").alias("now")), "path", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).withColumn(
        "state", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed"))


def governance(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """Relations of decisions (id, status, enforces array) with rules (id, unexpanded): one row (relation, decision, rule)."""
    asked = decisions.select(F.col("id").alias("decision"), "status", F.explode("enforces").alias("rule")).distinct()
    known = rules.select(F.col("id").alias("rule"), F.lit(True).alias("known")).distinct()
    rows = asked.join(known, "rule", "left")
    named = F.when(F.col("known").isNull(), "decision_missing_rule").when(F.col("status") == "accepted", "rule_governed_by").when(
        F.col("status") == "proposed", "proposed_decision_enforces").otherwise("superseded_decision_enforces")
    enforced = rows.select(named.alias("relation"), "decision", "rule")
    free = known.join(enforced.where("relation = 'rule_governed_by'"), "rule", "left_anti").select(
        F.lit("rule_without_decision").alias("relation"), F.lit(None).cast("string").alias("decision"), "rule")
    return enforced.unionByName(free)


def reconcile(bindings: DataFrame, definitions: DataFrame, now: int) -> DataFrame:
    """bindings (rule, symbol, bound_to array, stale_at) against definitions (symbol, path): what survives, where the
    symbol is now, the state (bound, moved, stale) and since when it is stale."""
    there = definitions.groupBy("symbol").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    paths = F.coalesce("paths", F.array().cast("array<string>"))
    kept, moved = F.array_intersect("bound_to", paths), F.array_except(paths, F.col("bound_to"))
    state = F.when(F.size(kept) > 0, "bound").when(F.size(moved) > 0, "moved").otherwise("stale")
    return bindings.drop("surviving", "relocated", "state").join(there, "symbol", "left").withColumns(
        {"surviving": kept, "relocated": moved, "state": state}).withColumn(
        "stale_at", F.when(F.col("state") == "stale", F.coalesce("stale_at", F.lit(now)))).drop("paths")


def stale_rules(reconciled: DataFrame) -> DataFrame:
    """Rules all of whose bindings are stale."""
    return reconciled.groupBy("rule").agg(F.bool_and(F.col("state") == "stale").alias("all_stale"), F.count("*").alias("n")).where("all_stale").drop("all_stale")


def pack_references(references: DataFrame, declarations: DataFrame, owners: DataFrame) -> DataFrame:
    """references (scope, name, site) to the one declaration site of (scope, name); several sites resolve to nothing.
    owners (site, scope, owner, is_test) gives the other end: tested_by for tests, else calls."""
    one = declarations.groupBy("scope", "name").agg(F.count_distinct("site").alias("n"), F.min("symbol").alias("target")).where("n = 1")
    return references.join(owners, ["scope", "site"]).join(one, ["scope", "name"]).select(
        F.when(F.col("is_test"), "tested_by").otherwise("calls").alias("p"),
        F.when(F.col("is_test"), F.array("target", "owner")).otherwise(F.array("owner", "target")).alias("a")).distinct()


def data_contracts(keys: DataFrame, consumers: DataFrame, fields: DataFrame) -> DataFrame:
    """keys (artifact, key), consumers (artifact, consumer, flatten, deny), fields (consumer, field): which field takes
    each key; a key that none takes is unconsumed, unless the consumer flattens or refuses unknown ones."""
    asked = keys.join(consumers, "artifact")
    took = asked.join(fields.select("consumer", F.col("field").alias("key"), F.lit(True).alias("took")), ["consumer", "key"], "left")
    relation = F.when(F.col("took"), "maps_data_key").when(~F.col("flatten") & ~F.col("deny"), "unconsumed_data_key")
    return took.select(relation.alias("relation"), "artifact", "key", "consumer").where("relation IS NOT NULL").distinct()


def canonical_callees(calls: DataFrame, definitions: DataFrame, imports: DataFrame, reexports: DataFrame | None = None, types: DataFrame | None = None,
                      impls: DataFrame | None = None, depth: int = 4) -> DataFrame:
    """calls (edge, src, caller, callee, receiver, is_method) with the one definition (fn, module, owner) they mean.

    A bare call never means a method; a method call needs its receiver's type; a definition counts if the caller's
    module is, lies in or imports its module (directly, by the whole unit, or through re-exports).  One candidate is
    the target, none is unresolved, several are ambiguous.  types (owner, declared_in) adds: a type that the caller's
    module declares makes its methods visible.  impls (owner, trait) lets a trait name its implementations.  Of several
    candidates for an unqualified receiver the one of the caller's own type is meant.
    """
    asked = calls.withColumns({"leaf": leaf(F.col("callee")), "module": F.regexp_replace("caller", "::[^:]*$", "")})
    known = definitions.select("fn", F.col("module").alias("home"), "owner", leaf(F.col("fn")).alias("leaf")).distinct()
    own = definitions.where("owner IS NOT NULL").groupBy(F.col("fn").alias("caller")).agg(F.min("owner").alias("own"))
    asked = asked.join(own, "caller", "left")
    visible = imports.select(F.col("from").alias("module"), F.col("to").alias("home")).distinct()
    if reexports is not None:
        step = reexports.select(F.col("module").alias("home"), F.col("target").alias("next")).distinct()
        hop = visible
        for _ in range(depth):
            hop = hop.join(step, "home").select("module", F.col("next").alias("home")).distinct()
            visible = visible.unionByName(hop).distinct()
    under = (F.col("module") == F.col("home")) | F.startswith("module", F.concat("home", F.lit("::")))
    method = F.col("owner").isNotNull()
    plain = lambda c: F.translate(F.regexp_replace(c, "<.*$", ""), "-", "_")
    typed, held = plain(F.col("receiver")), plain(F.col("owner"))
    qualified = F.coalesce(F.col("receiver").contains("::"), F.lit(False))
    right_type = F.coalesce(held == typed, F.lit(False)) | F.coalesce(F.endswith(held, F.concat(F.lit("::"), typed)), F.lit(False)) | (
        ~qualified & F.coalesce(leaf(held) == typed, F.lit(False)))
    # a definition of the leaf is looked up by each way in which it can be meant, never by the leaf alone: a common name has
    # as many definitions as there are packages
    parts = lambda c: F.split(c, "::")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts("module"))), lambda n: F.array_join(F.slice(parts("module"), F.lit(1), n), "::"))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts(held))), lambda n: F.array_join(F.slice(parts(held), n, F.size(parts(held))), "::"))
    free, methods = known.where("owner IS NULL"), known.where("owner IS NOT NULL")
    calls_, bare = asked.where("is_method AND receiver IS NOT NULL"), asked.where("NOT is_method")
    ways = [asked.withColumn("__fn", F.col("callee")).join(known.withColumn("__fn", F.col("fn")), ["__fn", "leaf"]).drop("__fn")]
    for some, theirs in ((bare, free), (calls_, methods)):
        ways.append(some.withColumn("home", F.explode(ups)).join(theirs, ["leaf", "home"]))
        ways.append(some.join(visible, "module").join(theirs, ["leaf", "home"]))
    ways.append(calls_.where(F.col("own").isNotNull()).withColumn("owner", F.col("own")).join(methods, ["leaf", "owner"]))
    far, named_ = calls_.where(qualified), methods.withColumn("__type", F.explode(ends))
    ways.append(far.withColumn("__type", typed).join(named_, ["leaf", "__type"]).drop("__type"))
    if types is not None:
        own_types = types.select("owner", F.col("declared_in").alias("module")).distinct()
        ways.append(calls_.join(own_types, "module").join(methods, ["leaf", "owner"]))
    if impls is not None:
        ways.append(far.join(impls.select("owner", F.col("trait").alias("receiver")).distinct(), "receiver").join(methods, ["leaf", "owner"]))
    nothing = {c: F.lit(None).cast("string") for c in ("fn", "home", "owner")}
    rows = reduce(DataFrame.unionByName, ways, asked.withColumns(nothing)).join(visible.withColumn("imported", F.lit(True)), ["module", "home"], "left")
    seen = under | F.coalesce("imported", F.lit(False)) | (F.col("is_method") & qualified)
    if types is not None:
        rows = rows.join(types.select("owner", F.col("declared_in").alias("module"), F.lit(True).alias("own_type")).distinct(), ["owner", "module"], "left")
        seen = seen | F.coalesce("own_type", F.lit(False))
    if impls is not None:
        rows = rows.join(impls.select("owner", F.col("trait").alias("receiver"), F.lit(True).alias("implements")).distinct(), ["owner", "receiver"], "left")
        right_type = right_type | F.coalesce("implements", F.lit(False))
    same = F.coalesce(F.col("owner") == F.col("own"), F.lit(False))
    seen = seen | same
    exact = F.col("fn") == F.col("callee")
    fits = F.when(F.col("is_method"), method & F.col("receiver").isNotNull() & F.coalesce(right_type, F.lit(False)) & seen).otherwise(~method & seen)
    ok = F.coalesce(exact | fits, F.lit(False))
    per = rows.withColumns({"ok": ok, "exact": F.coalesce(exact, F.lit(False)), "mine": same & F.col("is_method") & ~qualified}).groupBy("edge", "src", "caller", "callee").agg(
        F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("fn")))).alias("all"), F.max(F.when(F.col("exact"), F.col("fn"))).alias("exact"),
        F.array_sort(F.collect_set(F.when(F.col("ok") & F.col("mine"), F.col("fn")))).alias("mine"))
    target = F.coalesce("exact", F.when(F.size("all") == 1, F.col("all")[0]), F.when(F.size("mine") == 1, F.col("mine")[0]))
    return per.select("edge", "src", "caller", "callee", target.alias("target"),
                      F.when(target.isNotNull(), "resolved").when(F.size("all") == 0, "unresolved").otherwise("ambiguous").alias("outcome"))


def resolve_callees(calls: DataFrame, definitions: DataFrame, imports: DataFrame, bins: DataFrame | None = None, reexports: DataFrame | None = None, types: DataFrame | None = None,
                    impls: DataFrame | None = None, depth: int = 4) -> DataFrame:
    """canonical_callees() for edges as extractors write them, with p (calls or tested_by) beside the other columns.

    ``@bin:name`` is the entry point of that program (bins: package, name, main) of the caller's package; ``@extern:`` lies
    outside; ``@path:module|module:name`` is the one free function of that name that a listed module defines or re-exports
    (reexports may have an item; null is all).  tested_by means production definitions (column production), if any is
    marked so.
    """
    some = not definitions.where("production").isEmpty()
    pool = definitions.withColumn("p", F.explode(F.when(F.lit(not some) | F.coalesce("production", F.lit(False)), F.array(F.lit("calls"), F.lit("tested_by"))).otherwise(F.array(F.lit("calls")))))
    kind = F.regexp_extract("callee", "^@([a-z]+):", 1)
    marked = calls.withColumn("kind", kind)
    told = lambda rows, all_: rows.select("edge", "src", "caller", "callee", F.when(F.size(all_) == 1, all_[0]).alias("target"),
                                          F.when(F.size(all_) == 1, "resolved").when(F.size(all_) == 0, "unresolved").otherwise("ambiguous").alias("outcome"))
    none = F.array().cast("array<string>")
    out = told(marked.where("kind = 'extern'"), none)
    at_bin = marked.where("kind = 'bin'")
    if bins is None:
        out = out.unionByName(told(at_bin, none))
    else:
        named = at_bin.withColumns({"package": F.regexp_extract("caller", "^(.*?)(?:::|$)", 1), "name": F.regexp_extract("callee", "^@bin:(.*)$", 1)})
        there = named.join(bins, ["package", "name"], "left").join(pool.select("p", F.col("fn").alias("main"), F.lit(True).alias("there")).distinct(), ["p", "main"], "left")
        found = there.groupBy("edge", "src", "caller", "callee").agg(F.collect_set(F.when(F.col("there"), F.col("main"))).alias("all"))
        out = out.unionByName(told(found, F.col("all")))
    asked = marked.where("kind = 'path'").withColumns({"name": F.regexp_extract("callee", ":([^:]*)$", 1), "home": F.explode(F.split(F.regexp_extract("callee", "^@path:(.*):[^:]*$", 1), r"\|"))})
    free = pool.where("owner IS NULL").select("p", F.col("module").alias("home"), leaf(F.col("fn")).alias("name"), "fn").distinct()
    reached, front = None, asked.select("edge", "p", "name", "home").distinct()
    for level in range(depth + 1 if reexports is not None else 1):
        hit = front.join(free, ["p", "home", "name"], "left")
        reached = hit.where("fn IS NOT NULL").select("edge", "fn") if reached is None else reached.unionByName(hit.where("fn IS NOT NULL").select("edge", "fn"))
        if level == depth or reexports is None:
            break
        item = F.col("item") if "item" in reexports.columns else F.lit(None).cast("string")
        step = reexports.select(F.col("module").alias("home"), F.col("target").alias("next"), item.alias("item")).distinct()
        front = hit.where("fn IS NULL").drop("fn").join(step, "home").where("item IS NULL OR item = name").select("edge", "p", "name", F.col("next").alias("home")).distinct()
    found = asked.select("edge", "src", "caller", "callee").distinct().join(reached.groupBy("edge").agg(F.collect_set("fn").alias("all")), "edge", "left")
    out = out.unionByName(told(found, F.coalesce("all", none)))
    for p in ("calls", "tested_by"):
        star = None if reexports is None else reexports.where("item IS NULL") if "item" in reexports.columns else reexports
        out = out.unionByName(canonical_callees(marked.where((F.col("kind") == "") & (F.col("p") == p)).drop("kind", "p"), pool.where(F.col("p") == p).drop("p", "production"), imports, star, types, impls, depth))
    return out


def resolution_stats(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("src").agg(F.count_if(F.col("outcome") == "unresolved").alias("unresolved"), F.count_if(F.col("outcome") == "ambiguous").alias("ambiguous"))


def lexical_pairs(left: DataFrame, right: DataFrame, place: str | None = None) -> DataFrame:
    """(fn, left, right) sites of one function with the left before the right (and at the same place)."""
    on = ["fn", *([place] if place else [])]
    return left.select(*on, F.col("id").alias("left"), F.col("at").alias("__l")).join(
        right.select(*on, F.col("id").alias("right"), F.col("at").alias("__r")), on).where("__l < __r").select("fn", "left", "right")


def evidence(sites: DataFrame, functions: DataFrame, links: DataFrame) -> DataFrame:
    """Functions with their sites (sorted structs) and relationships to other sites; resolved tells whether those exist."""
    known = sites.select(F.col("id").alias("to"), F.lit(True).alias("there")).distinct()
    related = links.join(known, "to", "left").groupBy("fn").agg(F.array_sort(F.collect_list(
        F.struct("kind", "from", "to", F.coalesce("there", F.lit(False)).alias("resolved")))).alias("relationships"))
    own = sites.groupBy("fn").agg(F.array_sort(F.collect_list(F.struct("start", "end", "id", "kind"))).alias("sites"))
    return functions.select("fn").distinct().join(own, "fn", "left").join(related, "fn", "left")


def unique_ids(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


def survival(rows: DataFrame, before: str, after: str) -> DataFrame:
    """rows with what two sets share (surviving) and what only the later one holds (relocated), sorted."""
    return rows.withColumns({"surviving": F.array_sort(F.array_intersect(before, after)), "relocated": F.array_sort(F.array_except(after, before))})


def record_edges(records: DataFrame, shapes: dict[str, tuple[str, Sequence[str]]], src: str | None = None) -> DataFrame:
    """Typed records (kind, fields map) as base edges: shapes gives each kind its relation and the fields that are its
    arguments, in order; records of other kinds or without one of the fields give nothing."""
    out = None
    for kind, (relation, fields) in shapes.items():
        args = F.array(*[F.col("fields")[f] for f in fields])
        rows = records.where((F.col("kind") == kind) & F.forall(args, lambda a: a.isNotNull())).select(F.lit(relation).alias("p"), args.alias("a"), F.lit(src).cast("string").alias("src"), F.lit(False).alias("d"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


DERIVATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "no_direct_test": lambda e: derived(no_direct_test(e), "no_direct_test", ["fn"]),
    "test_reaches": lambda e: derived(test_reaches(e), "test_reaches", ["test", "fn"]),
    "bin_reaches": lambda e: derived(bin_reaches(e), "bin_reaches", ["main", "fn"]),
    "in_cycle": lambda e: derived(cycles(pairs(e, "imports")), "in_cycle", ["node", "cycle"]),
    "data_flows_to": lambda e: derived(data_flows(e), "data_flows_to", ["artifact", "consumer"]),
    "gaps": lambda e: artifact_gaps(e).select("p", F.array("artifact").alias("a"), F.lit(None).cast("string").alias("src"), F.lit(True).alias("d")),
}


def derive_all(edges: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Derived edges that are asked for (all by default), each once."""
    known = base(edges)
    out = None
    for name in wanted or DERIVATIONS:
        rows = DERIVATIONS[name](known)
        out = rows if out is None else out.unionByName(rows)
    return out.dropDuplicates(["p", "a"])


def not_reported(reported: DataFrame, capabilities: Sequence[str]) -> DataFrame:
    """Subjects with the capabilities of a fixed list on which nothing is reported about them."""
    asked = reported.select("subject").distinct().select("subject", F.explode(F.array(*map(F.lit, capabilities))).alias("capability"))
    return asked.join(reported.select("subject", "capability"), ["subject", "capability"], "left_anti")
