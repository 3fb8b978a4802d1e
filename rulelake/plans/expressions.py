"""Guard expressions compiled to Catalyst: boolean logic, arithmetic and text functions over a rule's bindings, lists, and
tests of the fact table, each of which becomes one grouped count joined back to the rows that ask for it.

    !facts_contain('order', ['*', '?c']) && bindings["?n"].parse_int() > 3
    facts.some(|f| f.predicate == "stock" && f.args[0] == bindings["?item"] && f.args[1].parse_int() >= 5)
    let late = facts.filter(|f| f.predicate == "late").map(|f| f.args[0]); bindings["?c"] in late
    if bindings["?s"] in ["A", "B"] { facts.len() > 9 } else { bindings["?s"].split("-").some(|p| p == "x") }
    facts.some(|f| f.predicate == "a" && !facts.some(|g| g.predicate == "b" && g.args[0] == f.args[0]))

A name that ``let`` gives stands for its expression. Inside a closure over facts, another test of the facts is counted for
each fact of the outer one: it is joined to those facts, once they are filtered, before they are counted themselves.

There is no interpreter: an expression is parsed once, within bounds on its length and depth, and can build no value that
its input does not hold.  A comparison of a number with a text, a text that is no number and a missing argument have no
value; a guard without a value is an error, and its rule fires with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds on one expression: characters, and nested operators.
LONGEST, DEEPEST = 4096, 64
TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>!().,\[\]|=;{}]))""")


class Malformed(ValueError):
    """An expression that cannot be compiled."""


@dataclass(eq=False)
class Value:
    """A compiled part: its column, its kind (bool, num, str, list, fact, facts, values, map), the columns that it reads
    (bindings, and predicate and arguments of facts by level of closure) and the counts that it needs."""

    kind: str
    column: Column | None = None
    reads: frozenset[str] = frozenset()
    needs: tuple[Count, ...] = ()
    conjuncts: tuple[Value, ...] = ()
    sides: tuple[Value, Value] | None = None  # of an equality
    filters: tuple[Value, ...] = ()  # of facts and values
    level: int = 0  # of a fact, facts and values
    item: Value | None = None  # what values are made of
    of: str = "str"  # kind of a list's items
    items: tuple[Value, ...] | None = None  # of a list as it is written


@dataclass(eq=False)
class Count:
    """How many facts hold, for each set of values that it reads from outside its closure."""

    filters: tuple[Value, ...]
    level: int
    reads: frozenset[str]
    name: str


def own(level: int) -> frozenset[str]:
    """Columns of the facts of a closure."""
    return frozenset((f"__p{level}", f"__a{level}"))


@dataclass
class Parser:
    text: str
    bound: set[str]
    at: int = 0
    depth: int = 0
    level: int = 0
    counted: int = 0
    scope: dict[str, Value] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.text) > LONGEST:
            raise Malformed("expression too long")
        self.tokens: list[tuple[str, str]] = []
        where, text = 0, self.text.rstrip()
        while where < len(text):
            m = TOKEN.match(text, where)
            if not m:
                raise Malformed(f"cannot read {text[where:where + 12]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            where = m.end()

    def peek(self, *what: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in what and self.tokens[self.at][0] != "str"

    def take(self, what: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or what is not None and not self.peek(what):
            raise Malformed(f"expected {what or 'more'} at token {self.at + 1}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Value:
        out = self.block()
        if self.at < len(self.tokens):
            raise Malformed(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def block(self) -> Value:
        """Names given by let, and the expression that they lead to."""
        outer = dict(self.scope)
        while self.peek("let"):
            self.take()
            kind, name = self.take()
            if kind != "name" or name in ("facts", "bindings", "if", "let"):
                raise Malformed(f"no name {name!r}")
            self.take("=")
            value = self.either()
            self.take(";")
            self.scope[name] = value
        out = self.either()
        self.scope = outer
        return out

    # one method for each level of binding strength

    def either(self) -> Value:
        self.depth += 1
        if self.depth > DEEPEST:
            raise Malformed("expression too deep")
        out = self.both()
        while self.peek("||", "or"):
            self.take()
            right = self.both()
            out = self.join(out, right, "bool", self.need(out, "bool") | self.need(right, "bool"))
        self.depth -= 1
        return out

    def both(self) -> Value:
        out = self.negation()
        while self.peek("&&", "and"):
            self.take()
            right = self.negation()
            parts = (out.conjuncts or (out,)) + (right.conjuncts or (right,))
            out = self.join(out, right, "bool", self.need(out, "bool") & self.need(right, "bool"))
            out.conjuncts = parts
        return out

    def negation(self) -> Value:
        if self.peek("!", "not"):
            self.take()
            self.depth += 1
            if self.depth > DEEPEST:
                raise Malformed("expression too deep")
            x = self.negation()
            self.depth -= 1
            return self.same(x, "bool", ~self.need(x, "bool"))
        return self.comparison()

    def comparison(self) -> Value:
        left = self.sum()
        if self.peek("in"):
            self.take()
            return self.member_of(left, self.sum())
        if not self.peek("==", "!=", "<", "<=", ">", ">="):
            return left
        op, right = self.take()[1], self.sum()
        return self.compared(left, op, right)

    def compared(self, left: Value, op: str, right: Value) -> Value:
        if left.kind != right.kind:
            raise Malformed(f"cannot compare {left.kind} with {right.kind}")
        a, b = self.need(left, left.kind), self.need(right, left.kind)
        out = self.join(left, right, "bool", {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
        out.sides = (left, right) if op == "==" and not out.needs else None
        return out

    def member_of(self, x: Value, of: Value) -> Value:
        """Whether x is in a list, among mapped facts, inside a text, or the name of a binding."""
        if of.kind == "str":
            return self.join(x, of, "bool", F.contains(of.column, self.need(x, "str")))
        if of.kind == "list":
            if x.kind != of.of:
                raise Malformed(f"no {x.kind} is in a list of {of.of}")
            return self.join(x, of, "bool", F.array_contains(of.column, x.column))
        if of.kind == "values":
            n = self.count((*of.filters, self.compared(of.item, "==", x)), of.level)
            return self.same(n, "bool", n.column > 0)
        raise Malformed(f"nothing is in {of.kind}")

    def sum(self) -> Value:
        out = self.product()
        while self.peek("+", "-"):
            op, right = self.take()[1], self.product()
            if out.kind == right.kind == "str" and op == "+":
                out = self.join(out, right, "str", F.concat(out.column, right.column))
                continue
            a, b = self.need(out, "num"), self.need(right, "num")
            out = self.join(out, right, "num", a + b if op == "+" else a - b)
        return out

    def product(self) -> Value:
        out = self.suffixed()
        while self.peek("*", "/", "%"):
            op, right = self.take()[1], self.suffixed()
            a, b = self.need(out, "num"), self.need(right, "num")
            out = self.join(out, right, "num", a * b if op == "*" else F.try_divide(a, b) if op == "/" else F.try_mod(a, b))
        return out

    def suffixed(self) -> Value:
        out = self.atom()
        while self.peek(".", "["):
            if self.take()[1] == "[":
                index = self.either()
                self.take("]")
                if out.kind == "list" and index.kind == "num":
                    out = self.join(out, index, out.of, F.try_element_at(out.column, (index.column + 1).cast("int")))
                elif out.kind == "map" and self.tokens[self.at - 2][0] == "str":
                    out = self.binding(text_of(self.tokens[self.at - 2][1]))
                else:
                    raise Malformed(f"{out.kind} has no items")
                continue
            out = self.member(out, self.take()[1])
        return out

    def member(self, x: Value, name: str) -> Value:
        if x.kind == "fact" and name in ("predicate", "args"):
            column = f"__{name[0]}{x.level}"
            return Value("str" if name == "predicate" else "list", F.col(column), frozenset([column]))
        if x.kind in ("facts", "values") and name in ("some", "all", "filter", "map"):
            bind = Value("fact", level=x.level) if x.kind == "facts" else x.item
            body = self.closure(bind, x.level + 1)
            if name == "map":
                if body.kind not in ("str", "num", "bool"):
                    raise Malformed(f"facts are not mapped to {body.kind}")
                return Value("values", filters=x.filters, level=x.level, item=body)
            self.need(body, "bool")
            if name == "filter":
                return Value(x.kind, filters=(*x.filters, *(body.conjuncts or (body,))), level=x.level, item=x.item)
            if name == "all":  # no fact for which it fails
                n = self.count((*x.filters, self.same(body, "bool", F.coalesce(~body.column, F.lit(True)))), x.level)
                return self.same(n, "bool", n.column == 0)
            n = self.count((*x.filters, *(body.conjuncts or (body,))), x.level)
            return self.same(n, "bool", n.column > 0)
        if x.kind == "list" and name in ("some", "all", "filter", "map"):
            return self.over_list(x, name)
        called = self.peek("(")
        if called:
            self.take("(")
        args = [] if not called or self.peek(")") else [self.either()]
        if called:
            self.take(")")
        return self.call(name, x, *args)

    def over_list(self, x: Value, name: str) -> Value:
        if x.items is not None and name in ("some", "all"):  # written out: the closure stands once for each item
            start, out = self.at, None
            for item in x.items:
                self.at = start
                part = self.closure(item, self.level)
                self.need(part, "bool")
                out = part if out is None else self.join(out, part, "bool", out.column | part.column if name == "some" else out.column & part.column)
            if out is None:
                self.closure(Value("str", F.lit("")), self.level)
                out = Value("bool", F.lit(name == "all"))
            return self.join(x, out, "bool", out.column)
        told: list[Value] = []

        def body(item: Column) -> Column:
            told.append(self.closure(Value(x.of, item, x.reads), self.level))
            if told[-1].needs:
                raise Malformed("facts are not tested for each item of a list")
            return self.need(told[-1], told[-1].kind if name == "map" else "bool")
        column = {"some": F.exists, "all": F.forall, "filter": F.filter, "map": F.transform}[name](x.column, body)
        out = self.join(x, told[0], "bool" if name in ("some", "all") else "list", column)
        out.of = told[0].kind if name == "map" else x.of
        return out

    def call(self, name: str, x: Value, *args: Value) -> Value:
        if name in ("len", "is_empty") and not args:
            n = self.count(x.filters, x.level) if x.kind in ("facts", "values") else self.same(x, "num", (F.size(x.column) if x.kind == "list" else F.length(self.need(x, "str"))).cast("double"))
            return n if name == "len" else self.same(n, "bool", n.column == 0)
        text = {"parse_int": ("num", lambda c: c.try_cast("bigint").cast("double")), "parse_float": ("num", lambda c: c.try_cast("double")), "int": ("num", lambda c: c.try_cast("bigint").cast("double")),
                "to_lower": ("str", F.lower), "to_upper": ("str", F.upper), "lower": ("str", F.lower), "upper": ("str", F.upper), "trim": ("str", F.trim)}
        if name in text and not args:
            kind, f = text[name]
            return self.same(x, kind, f(self.need(x, "str")))
        if name == "contains" and len(args) == 1 and x.kind in ("list", "values"):
            return self.member_of(args[0], x)
        two = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith, "startswith": F.startswith, "endswith": F.endswith}
        if name in two and len(args) == 1:
            return self.join(x, args[0], "bool", two[name](self.need(x, "str"), self.need(args[0], "str")))
        if name == "split" and len(args) == 1:
            quoted = F.concat(F.lit("\\Q"), self.need(args[0], "str"), F.lit("\\E"))
            return self.join(x, args[0], "list", F.split(self.need(x, "str"), quoted, -1))
        raise Malformed(f"unknown function {name}")

    def closure(self, bind: Value, level: int) -> Value:
        self.take("(")
        self.take("|")
        kind, name = self.take()
        if kind != "name":
            raise Malformed(f"no name {name!r}")
        self.take("|")
        outer, before = self.scope, self.level
        self.scope, self.level = {**outer, name: bind}, level
        if self.peek("{"):
            self.take()
            body = self.block()
            self.take("}")
        else:
            body = self.either()
        self.scope, self.level = outer, before
        self.take(")")
        return body

    def choice(self) -> Value:
        asked = self.either()
        self.take("{")
        a = self.block()
        self.take("}")
        self.take("else")
        if self.peek("if"):
            self.take()
            b = self.choice()
        else:
            self.take("{")
            b = self.block()
            self.take("}")
        if a.kind != b.kind:
            raise Malformed(f"{a.kind} or {b.kind}")
        condition = self.need(asked, "bool")
        out = self.join(self.join(asked, a, a.kind, a.column), b, a.kind, F.when(condition, self.need(a, a.kind)).when(~condition, self.need(b, a.kind)))
        out.of = a.of
        return out

    def atom(self) -> Value:
        kind, text = self.take()
        if kind == "num":
            return Value("num", F.lit(float(text)))
        if kind == "str":
            return Value("str", F.lit(text_of(text)))
        if text == "-":
            x = self.suffixed()
            return self.same(x, "num", -self.need(x, "num"))
        if text == "(":
            out = self.either()
            self.take(")")
            return out
        if text == "[":
            return self.listed()
        if kind != "name":
            raise Malformed(f"unexpected {text!r}")
        if text == "if":
            return self.choice()
        if text in self.scope:
            return self.scope[text]
        if text in ("true", "false"):
            return Value("bool", F.lit(text == "true"))
        if text in ("bindings", "b"):
            return Value("map")
        if text == "facts":
            return Value("facts", level=self.level)
        if text in ("facts_contain", "facts_count"):
            return self.builtin(text)
        if self.peek("("):
            self.take("(")
            args = []
            while not self.peek(")"):
                args.append(self.either())
                if not self.peek(")"):
                    self.take(",")
            self.take(")")
            if args:
                return self.call(text, *args)
        raise Malformed(f"unknown name {text}")

    def listed(self) -> Value:
        items: list[Value] = []
        while not self.peek("]"):
            items.append(self.either())
            if not self.peek("]"):
                self.take(",")
        self.take("]")
        if not items:
            return Value("list", F.array().cast("array<string>"), items=())
        kind = items[0].kind
        column = F.array(*[self.need(x, kind) for x in items])
        if kind not in ("str", "num", "bool"):
            raise Malformed(f"no list of {kind}")
        return Value("list", column, frozenset().union(*(x.reads for x in items)), distinct(*(x.needs for x in items)), of=kind, items=tuple(items))

    def builtin(self, name: str) -> Value:
        self.take("(")
        predicate = self.string()
        self.take(",")
        self.take("[")
        args = []
        while not self.peek("]"):
            args.append(self.string())
            if not self.peek("]"):
                self.take(",")
        self.take("]")
        self.take(")")
        p, a = f"__p{self.level}", f"__a{self.level}"
        size = F.size(a) == len(args) if name == "facts_contain" else F.size(a) >= len(args)
        parts = [Value("bool", (F.col(p) == predicate) & size, own(self.level))]
        for i, text in enumerate(args):
            if text != "*":
                parts.append(self.compared(Value("str", F.try_element_at(a, F.lit(i + 1)), frozenset([a])), "==", self.substituted(text)))
        n = self.count(tuple(parts), self.level)
        return self.same(n, "bool", n.column > 0) if name == "facts_contain" else n

    def string(self) -> str:
        kind, text = self.take()
        if kind != "str":
            raise Malformed(f"expected a text, not {text!r}")
        return text_of(text)

    def substituted(self, text: str) -> Value:
        from .guards import template
        from ..model import VARIABLE

        reads = frozenset(v for v in VARIABLE.findall(text) if v in self.bound)
        return Value("str", template(text, {v: F.col(f"`{v}`") for v in reads}), reads)

    def binding(self, name: str) -> Value:
        if name not in self.bound:
            raise Malformed(f"no binding {name}")
        return Value("str", F.col(f"`{name}`"), frozenset([name]))

    def count(self, filters: tuple[Value, ...], level: int) -> Value:
        reads = frozenset().union(*(v.reads for v in filters)) - own(level)
        self.counted += 1
        c = Count(filters, level, reads, f"__n{self.counted}")
        return Value("num", F.col(c.name).cast("double"), reads, (c,))

    def need(self, x: Value, kind: str) -> Column:
        if x.kind != kind or x.column is None:
            raise Malformed(f"expected {kind}, found {x.kind}")
        return x.column

    def same(self, x: Value, kind: str, column: Column) -> Value:
        return Value(kind, column, x.reads, x.needs)

    def join(self, a: Value, b: Value, kind: str, column: Column) -> Value:
        return Value(kind, column, a.reads | b.reads, distinct(a.needs, b.needs))


def distinct(*needs: tuple[Count, ...]) -> tuple[Count, ...]:
    return tuple({id(c): c for some in needs for c in some}.values())


def text_of(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1])


def compiled(script: str, bound: set[str]) -> tuple[Value, list[Count]]:
    """The expression's value and the counts of facts that it needs; Malformed unless it gives a boolean."""
    value = Parser(script, bound).whole()
    if value.kind != "bool":
        raise Malformed(f"not a boolean: {value.kind}")
    return value, list(value.needs)


def with_counts(rows: DataFrame, facts: DataFrame, counts: Iterable[Count]) -> DataFrame:
    for c in counts:
        if c.name not in rows.columns:
            rows = counted(rows, facts, c)
    return rows


def counted(rows: DataFrame, facts: DataFrame, count: Count) -> DataFrame:
    """rows with the column count.name. Facts are filtered first; equalities with what rows hold are the keys of the join,
    and what else ties a fact to a row is tested on the pairs that meet there."""
    inside = own(count.level)
    there = facts.select(F.col("predicate").alias(f"__p{count.level}"), F.col("args").alias(f"__a{count.level}"))
    for v in sorted((v for v in count.filters if v.reads <= inside), key=lambda v: len(v.needs)):
        there = with_counts(there, facts, v.needs).where(v.column).select(*there.columns)
    if not count.reads:
        return rows.crossJoin(F.broadcast(there.agg(F.count("*").alias(count.name))))  # one row
    keys, rest = [], []
    for v in count.filters:
        sides = v.sides or ()
        fact = next((s for s in sides if s.reads and s.reads <= inside), None)
        bind = next((s for s in sides if s.reads and not s.reads & inside), None)
        if fact is not None and bind is not None:
            keys.append((bind, fact))
        elif not v.reads <= inside:
            rest.append(v)
    reads = sorted(count.reads)
    names = [f"__k{count.level}_{i}" for i in range(len(keys))]
    if not rest:
        n = there.groupBy(*[f.column.alias(k) for (_, f), k in zip(keys, names)]).agg(F.count("*").alias(count.name))
        asked = rows
        for (b, _), k in zip(keys, names):
            asked = asked.withColumn(f"{k}b", b.column)
        joined = asked.join(n, [F.col(f"{k}b") == F.col(k) for k in names], "left")
        return joined.withColumn(count.name, F.coalesce(count.name, F.lit(0))).drop(*names, *[f"{k}b" for k in names])
    asked = rows.select(*[F.col(f"`{r}`") for r in reads]).distinct()
    for (b, _), k in zip(keys, names):
        asked = asked.withColumn(k, b.column)
    there = there.select("*", *[f.column.alias(f"{k}f") for (_, f), k in zip(keys, names)])
    on = [F.col(k) == F.col(f"{k}f") for k in names] or F.lit(True)
    pairs = asked.join(there, on)  # without an equality every pair is asked for
    for v in sorted(rest, key=lambda v: len(v.needs)):
        pairs = with_counts(pairs, facts, v.needs).where(v.column)
    n = pairs.groupBy(*[F.col(f"`{r}`") for r in reads]).agg(F.count("*").alias(count.name))
    return rows.join(n, reads, "left").withColumn(count.name, F.coalesce(count.name, F.lit(0)))


def apply(rows: DataFrame, facts: DataFrame, script: str, bound: set[str], name: str) -> DataFrame:
    """rows (columns named like their variables) with the guard's value in the column of that name."""
    value, counts = compiled(script, bound)
    return with_counts(rows, facts, counts).withColumn(name, value.column).drop(*[c.name for c in counts])
