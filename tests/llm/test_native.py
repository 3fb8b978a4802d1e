import datetime as dt
import json
import random

from rulelake.llm import toolcalls, urlfilter

SCHEMAS = {"f": {"q": ("string", True, 1, 5), "n": ("integer", False, 0, 10), "x": ("number", False, None, 1), "b": ("boolean", False, None, None)}}


def brute_errors(name, text):
    try:
        args = json.loads(text)
    except (TypeError, ValueError):
        return ["unparsable"]
    if not isinstance(args, dict):
        return ["unparsable"]
    if name not in SCHEMAS:
        return ["unknown_tool"]
    out = [f"unknown:{k}" for k in args if k not in SCHEMAS[name]]
    for f, (kind, required, least, most) in SCHEMAS[name].items():
        if f not in args:
            out += [f"missing:{f}"] * required
            continue
        v = args[f]
        right = {"string": isinstance(v, str), "integer": type(v) is int, "number": type(v) in (int, float), "boolean": isinstance(v, bool)}[kind]
        size = len(v) if isinstance(v, str) else v
        if not right:
            out.append(f"type:{f}")
        elif kind != "boolean" and ((least is not None and size < least) or (most is not None and size > most)):
            out.append(f"range:{f}")
    return sorted(out)


def test_linking_against_brute_force(spark):
    r = random.Random(3)
    args = ['{"q":"ab","n":3}', '{"n": 11, "q": "é\\"\\n", "z": [2, {"b": 1, "a": null}]}', '{"q":""}', '{"q":7,"x":0.5,"b":"no"}', "[1]", "{bad", None,
            '{"x":2.5,"q":"toolong","b":true}', "{}"]
    calls = [(c, r.choice([None, *range(6)]), r.choice([f"i{k}" for k in range(5)] + [None]), r.choice(["f", "g", None]), r.choice(args))
             for c in [1, 1, 1, 2, None] for _ in range(8)]
    calls += [calls[0], calls[0]]
    results = [(c, r.choice([None, *range(6)]), r.choice([f"i{k}" for k in range(7)] + [None]), r.choice(["r", 'q"\\', None])) for c in [1, 1, 2, None] for _ in range(6)]
    results += [results[0]]
    a = spark.createDataFrame([(*c, "json") for c in calls], "conv_id long, turn long, call_id string, name string, arguments string, content string")
    b = spark.createDataFrame([(*x, 0) for x in results], "conv_id long, turn long, call_id string, content string, c int")
    rows = toolcalls.link(a, b, SCHEMAS, turns=2).collect()
    assert len(rows) == len(calls) + len(results)
    low = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    want, firsts, answers = [], {}, {}
    for c in calls:
        if None not in (c[0], c[2]):
            k = (c[0], c[2])
            firsts[k] = min(firsts.get(k, c), c, key=lambda c: (low(c[1]), text(c[3]), text(c[4])))
    for x in results:
        if None not in (x[0], x[2]):
            k = (x[0], x[2])
            answers[k] = min(answers.get(k, x), x, key=lambda x: (low(x[1]), text(x[3])))
    seen = set()
    for c in calls:
        k, keyed = (c[0], c[2]), None not in (c[0], c[2])
        lead = keyed and c == firsts[k] and c not in seen
        seen.add(c)
        bad = brute_errors(c[3], c[4])
        status = "duplicate_call" if keyed and not lead else "invalid" if bad else "ok" if keyed and k in answers else "unanswered"
        parsed = None if bad == ["unparsable"] else json.loads(c[4])
        told = {"arguments": parsed, "call_id": c[2], "errors": bad, "name": c[3], "result": answers[k][3] if lead and k in answers else None}
        want.append((c[0], "call", c[2], c[1], status, json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    seen = set()
    for x in results:
        k, keyed = (x[0], x[2]), None not in (x[0], x[2])
        status = "orphan" if not keyed or k not in firsts else "linked" if x == answers[k] and x not in seen else "duplicate_result"
        seen.add(x)
        want.append((x[0], "result", x[2], x[1], status, json.dumps({"call_id": x[2], "content": x[3]}, separators=(",", ":"), ensure_ascii=False)))
    got = [(x.conv_id, x.kind, x.call_id, x.turn, x.status, x.json) for x in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    for conv in (1, 2, None):
        own = sorted((x for x in rows if x.conv_id == conv), key=lambda x: x.position)
        assert [x.position for x in own] == list(range(len(own)))
        place = {}
        for x in own:
            if x.kind == "call":
                place.setdefault(x.call_id, x.position)
        for x in own:
            if x.status == "linked":
                lead = [y for y in own if y.kind == "call" and y.call_id == x.call_id and y.status != "duplicate_call"]
                assert lead and lead[0].position < x.position
    assert toolcalls.link(a.limit(0), b.limit(0), SCHEMAS).collect() == []


def test_temporal_lists_against_brute_force(spark):
    r = random.Random(5)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    domains = ["a.com", "x.a.com", "com", "b.org", "y.b.org", "solo", None]
    events = [(r.choice(["l1", "l2"]), r.choice(domains), day(r.randint(0, 30)), r.choice(["add", "remove"]), r.randint(0, 3)) for _ in range(60)]
    urls = ["http://x.a.com/p", "https://u:p@A.com:80?q", "ftp://z.x.a.com#f", "http://y.b.org", "http://solo/", "nonsense", None, "", "http://c.net/x.a.com"]
    caps = [(i, r.choice(urls), r.choice([day(r.randint(0, 40)), None]), "d") for i in range(120)]
    e = spark.createDataFrame(events, "list string, domain string, day date, action string, seq int")
    c = spark.createDataFrame(caps, "page_id long, url string, day date, domain string").withColumnRenamed("domain", "other")
    got = {x.page_id: x for x in urlfilter.judge(c, e).collect()}
    assert len(got) == len(caps)
    for i, url, d, _ in caps:
        host = {"http://x.a.com/p": "x.a.com", "https://u:p@A.com:80?q": "a.com", "ftp://z.x.a.com#f": "z.x.a.com", "http://y.b.org": "y.b.org",
                "http://solo/": "solo", "http://c.net/x.a.com": "c.net"}.get(url)
        labels = host.split(".") if host else []
        names = [host] if len(labels) == 1 else [".".join(labels[k:]) for k in range(len(labels) - 1)]
        active = []
        for lst in ("l1", "l2"):
            for n in names:
                known = [x for x in events if d and x[0] == lst and x[1] == n and x[2] <= d]
                if known and max(known, key=lambda x: (x[2], x[4], x[3]))[3] == "add":
                    active.append((-len(n), lst, n))
        x = got[i]
        assert (x.host, x.n_active, x.blocked) == (host, len(active), bool(active))
        assert (x.matched_list, x.matched_domain) == (min(active)[1:] if active else (None, None))
    assert not any(x.blocked for x in urlfilter.judge(c, e.limit(0)).collect()) and urlfilter.judge(c.limit(0), e).collect() == []


def test_hosts_and_their_parents(spark):
    want = {"http://u@a:b@evil.com/x": ("evil.com", ["evil.com"]), "http://A.b.Com./x": ("a.b.com", ["a.b.com", "b.com"]), "http://[2001:db8::1]:80/x": ("[2001:db8::1]", ["[2001:db8::1]"]),
            "http://1.2.3.4:80": ("1.2.3.4", ["1.2.3.4"]), "https://evil.com\\@good.com/": ("evil.com", ["evil.com"]), "http://...": (None, None), "http://a.b@": (None, None), "http:/x.com": (None, None),
            "http://1.2.3.4.com": ("1.2.3.4.com", ["1.2.3.4.com", "2.3.4.com", "3.4.com", "4.com"]), "mailto:x@a.com": (None, None)}
    rows = spark.createDataFrame([(u,) for u in want], "url string")
    got = {r.url: (r.h, r.p) for r in rows.select("url", urlfilter.host_of(rows.url).alias("h"), urlfilter.parents(urlfilter.host_of(rows.url)).alias("p")).collect()}
    assert got == want


def test_captures_with_clashing_columns(spark):
    e = spark.createDataFrame([("l", "a.com", dt.date(2024, 1, 1), "add", 1)], "list string, domain string, day date, action string, seq int")
    c = spark.createDataFrame([("http://x.a.com", dt.date(2024, 2, 1), 7, "own", "d", "s")], "url string, day date, n_active int, host string, domain string, since string")
    row = urlfilter.judge(c, e).first().asDict()
    assert row == {"url": "http://x.a.com", "day": dt.date(2024, 2, 1), "domain": "d", "since": "s", "host": "x.a.com", "n_active": 1, "matched_list": "l", "matched_domain": "a.com",
                   "listed_since": dt.date(2024, 1, 1), "blocked": True}


def test_arguments_with_a_repeated_key_are_unparsable(spark):
    calls = spark.createDataFrame([(1, 0, "c", "search", '{"query":"a","query":"b"}')], "conv_id long, turn int, call_id string, name string, arguments string")
    row = toolcalls.link(calls, spark.createDataFrame([], "conv_id long, turn int, call_id string, content string"), SCHEMAS).first()
    assert row.status == "invalid" and json.loads(row.json) == {"arguments": None, "call_id": "c", "errors": ["unparsable"], "name": "search", "result": None}


def test_calls_stand_after_what_they_need(spark):
    schema = {"f": {"q": ("string", True, None, None)}}
    call = lambda conv, turn, name, *needs: (conv, turn, name, "f", json.dumps({"q": " and ".join("{{%s}}" % n for n in needs)}))
    rows = [call(1, 0, "a", "b"), call(1, 1, "b", "c"), call(1, 2, "c"), call(1, 5, "d", "a"), call(1, 6, "e", "nowhere"),  # a and b wait for c's result
            call(2, 0, "x", "y"), call(2, 1, "y", "z"), call(2, 2, "z", "x"), call(2, 3, "w", "w"), call(2, 4, "v", "x"),  # a circle, a call that needs itself
            call(3, None, "n", "m"), call(3, 4, "m"), call(3, 4, "m"), (4, 0, "p", "f", '{"q":"{{q}}"'), call(4, 3, "q"), call(None, 0, "r", "r"), *[call(5, k, f"c{k}", f"c{k + 1}") for k in range(20)], call(5, 20, "c20")]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 4, "c", "r"), (1, 9, "a", "r"), (3, 8, "m", "r"), (2, 5, "x", "r")], "conv_id long, turn long, call_id string, content string")
    got = toolcalls.link(calls, results, schema, turns=3).collect()
    assert len(got) == len(rows) + 4
    order = {}
    for x in sorted((x for x in got if x.conv_id is not None), key=lambda x: (x.conv_id, x.position)):
        order.setdefault(x.conv_id, []).append((x.kind, x.call_id, x.status))
    place = {x[:2]: i for i, x in enumerate(order[1])}
    assert place["result", "c"] < place["call", "b"] < place["call", "a"] < place["result", "a"] < place["call", "d"]
    assert {x.call_id: x.status for x in got if x.conv_id == 2 and x.kind == "call"} == {"x": "cyclic", "y": "cyclic", "z": "cyclic", "w": "cyclic", "v": "cyclic"}
    assert [x[1] for x in order[3]][-2:] == ["m", "n"] and [s for _, i, s in order[3] if i == "n"] == ["unanswered"]
    assert [x[:2] for x in order[4]] == [("call", "p"), ("call", "q")] and [x[1] for x in order[5]] == [f"c{k}" for k in range(20, -1, -1)]
    assert [json.loads(x.json)["errors"] for x in got if x.call_id == "e"] == [["dangling:nowhere"]]


def plain_places(needs, turn, answered):
    """after and hops of each call of one conversation, None if it needs itself or hangs on such a call."""
    state, out = {}, {}

    def visit(c):
        state[c] = 1
        best = (turn[c], 0)
        for n in needs.get(c, ()):
            if n not in turn:
                continue
            if state.get(n) == 1:
                best = None
            elif state.get(n) is None:
                visit(n)
            if best is None or out.get(n) is None:
                best = None
                continue
            best = max(best, (answered.get(n, -1), 1), (out[n][0], out[n][1] + 1))
        state[c], out[c] = 2, best

    for c in turn:
        if state.get(c) is None:
            visit(c)
    bad = {c for c, v in out.items() if v is None}
    while True:  # what was visited while a circle was open
        more = {c for c in turn if c not in bad and any(n in bad for n in needs.get(c, ()))}
        if not more:
            return {c: None if c in bad else v for c, v in out.items()}
        bad |= more


def moved(spark, conversations):
    rows = [(conv, c, turn[c], n, turn.get(n), answered.get(n)) for conv, (needs, turn, answered) in conversations.items() for c, own in needs.items() for n in own if n in turn]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, at long, needs string, needs_at long, answered_at long")
    return {(r.conv_id, r.call_id): None if r.cyclic else (r.after, r.hops) for r in toolcalls._moved(df).collect()}


def test_chains_of_any_length_beside_circles(spark, monkeypatch):
    import sys

    sys.setrecursionlimit(10_000)
    chain = lambda n: ({f"c{i:04}": [f"c{i + 1:04}"] for i in range(n)}, {f"c{i:04}": i for i in range(n + 1)}, {f"c{n:04}": n + 5})
    ring = lambda n: ({f"r{i:04}": [f"r{(i + 1) % n:04}"] for i in range(n)} | {"hang": ["r0000"], "free": ["end"]}, {f"r{i:04}": i for i in range(n)} | {"hang": 3, "free": 1, "end": 9}, {})
    both = ({**chain(70)[0], "c0035": ["c0036", "x"], "x": ["y"], "y": ["x"]}, {**chain(70)[1], "x": 1, "y": 2}, {})
    conversations = {1: chain(40), 2: chain(100), 3: chain(1000), 4: ring(2), 5: ring(200), 6: both, 7: ({"s": ["s"]}, {"s": 0}, {})}
    rounds, made = [], toolcalls._substituted
    monkeypatch.setattr(toolcalls, "_substituted", lambda df: rounds.append(1) or made(df))
    got = moved(spark, conversations)
    for conv, (needs, turn, answered) in conversations.items():
        want = plain_places(needs, turn, answered)
        assert {c: v for (k, c), v in got.items() if k == conv} == {c: want[c] for c in needs}
    assert len(rounds) <= 14


def test_random_needs_against_plain_order(spark):
    r = random.Random(9)
    conversations = {}
    for conv in range(25):
        n = r.randint(2, 30)
        turn = {f"c{i}": r.randint(0, n) for i in range(n)}
        later = r.random() < 0.6  # needs of calls with a greater number only: no circles
        needs = {f"c{i}": list({f"c{r.randrange(i + 1 if later else 0, n)}" for _ in range(r.choice([1, 1, 2, 3]))}) for i in range(n - 1) if r.random() < 0.7}
        conversations[conv] = (needs, turn, {c: t + r.randint(0, 9) for c, t in turn.items() if r.random() < 0.5})
    got = moved(spark, conversations)
    for conv, (needs, turn, answered) in conversations.items():
        want = plain_places(needs, turn, answered)
        assert {c: v for (k, c), v in got.items() if k == conv} == {c: want[c] for c in needs}
