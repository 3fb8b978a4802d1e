"""Facts and graph edges read from source text: Python through its own parser, Rust, TypeScript and Swift from masked text
(comments and strings blanked, so that only code is matched) with functions found by their braces.

A file is read in one piece, in Arrow batches; a file that cannot be parsed gives the one row ``unparsable``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From so many parameters (or bindings, bases, wrappers) on a count is reported.
MANY = {"python_params": 6, "ts_params": 5, "rust_params": 6, "clones": 4, "lets": 12, "let_muts": 6, "inheritance": 3, "delegations": 4, "isinstance": 3}
LANGUAGES = {"py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "swift": "swift"}
MODULE = "<module>"
Row = tuple[str, list[str]]


# ---------------------------------------------------------------- Python

MUTABLE = (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)
READS = {"open", "input", "urlopen"}
CHANGES = {"append", "extend", "update", "add", "pop", "clear", "insert", "remove", "setdefault", "discard"}


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return None


def mutable(node: ast.AST | None) -> bool:
    return isinstance(node, MUTABLE) or isinstance(node, ast.Call) and dotted(node.func) in ("list", "dict", "set", "bytearray")


class PythonFacts(ast.NodeVisitor):
    def __init__(self, tree: ast.Module):
        self.rows: list[Row] = []
        self.edges: list[Row] = []
        self.scope: list[ast.AST] = []
        self.names: list[str] = []
        self.globals_ = {t.id for n in tree.body if isinstance(n, ast.Assign) and mutable(n.value) for t in n.targets if isinstance(t, ast.Name)}
        self.bases = {n.name: [dotted(b) for b in n.bases] for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}
        self.elifs = {id(n.orelse[0]) for n in ast.walk(tree) if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If)}
        self.visit(tree)

    def say(self, predicate: str, *args) -> None:
        self.rows.append((predicate, [str(a) for a in args]))

    @property
    def where(self) -> str:
        return next((n.name for n in reversed(self.scope) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), MODULE)

    def enter(self, node) -> None:
        self.scope.append(node)
        self.names.append(node.name)
        self.generic_visit(node)
        self.scope.pop()
        self.names.pop()

    def visit_FunctionDef(self, node) -> None:
        in_class = bool(self.scope) and isinstance(self.scope[-1], ast.ClassDef)
        self.edges.append(("defines_test" if node.name.startswith("test") else "defines_method" if in_class else "defines_fn", [".".join([*self.names, node.name])]))
        a = node.args
        params = [p.arg for p in [*a.posonlyargs, *a.args, *a.kwonlyargs] if not (in_class and p.arg in ("self", "cls"))]
        if len(params) >= MANY["python_params"]:
            self.say("python_function_param_count_high", node.name, len(params))
        ordered = [*a.posonlyargs, *a.args]
        for p, default in [*zip(ordered[len(ordered) - len(a.defaults):], a.defaults), *((p, x) for p, x in zip(a.kwonlyargs, a.kw_defaults) if x)]:
            if mutable(default):
                self.say("python_mutable_default_arg", node.name, p.arg)
            elif isinstance(default, ast.Call):
                self.say("python_call_in_default_arg", node.name, p.arg, dotted(default.func) or "")
        if not node.name.startswith("_") and ast.get_docstring(node) is None:
            self.say("python_function_missing_docstring", node.name)
        if in_class and node.name == "__new__":
            self.say("python_new_override", self.scope[-1].name, node.name)
        if isinstance(node, ast.AsyncFunctionDef):
            self.say("function_is_async", node.name)
        if node.name.startswith("test") and not any(isinstance(n, ast.Assert) or isinstance(n, ast.Call) and re.search(r"(^|\.)(assert\w*|raises|fail)$", dotted(n.func) or "") for n in ast.walk(node)):
            self.say("test_without_assertion", node.name)
        self.enter(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        methods = {m.name: m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))}
        if len(node.bases) > 1:
            self.say("python_multiple_inheritance", node.name, len(node.bases))
        depth, seen, now = 0, set(), node.name
        while now in self.bases and now not in seen and self.bases[now]:
            seen.add(now)
            depth, now = depth + 1, self.bases[now][0]
        if depth >= MANY["inheritance"]:
            self.say("python_inheritance_depth", node.name, depth)
        if "Mixin" in node.name and "__init__" in methods:
            self.say("python_mixin_with_init", node.name)
        it = methods.get("__iter__")
        if it and "__next__" in methods and any(isinstance(n, ast.Return) and isinstance(n.value, ast.Name) and n.value.id == "self" for n in ast.walk(it)):
            self.say("python_container_is_own_iterator", node.name)
        for n in node.body:
            for t in n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []:
                if mutable(n.value) and isinstance(t, ast.Name):
                    self.say("python_mutable_class_attribute", node.name, t.id)
        passed_on: dict[str, int] = {}
        for m in methods.values():
            value = m.body[-1].value if len(m.body) == 1 and isinstance(m.body[0], (ast.Return, ast.Expr)) else None
            target = dotted(value.func) if isinstance(value, ast.Call) else None
            if target and target.startswith("self.") and target.endswith(f".{m.name}"):
                passed_on[target.split(".")[1]] = passed_on.get(target.split(".")[1], 0) + 1
        for attribute, n in passed_on.items():
            if n >= MANY["delegations"]:
                self.say("python_static_delegation_wrapper", node.name, attribute, n)
        self.edges.append(("defines_type", [".".join([*self.names, node.name])]))
        self.enter(node)

    def visit_ExceptHandler(self, node) -> None:
        if node.type is None:
            self.say("python_bare_except", self.where)
        if len(node.body) == 1 and isinstance(node.body[0], ast.Pass):
            self.say("python_exception_handler_passes", self.where, dotted(node.type) or "" if node.type else "")
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        name = dotted(node.func) or ""
        if name:
            self.edges.append(("calls", [".".join(self.names) or MODULE, name]))
        if name == "print":
            self.say("python_print_call", self.where)
        if not self.scope and (name in READS or name.split(".")[0] in ("requests", "socket", "subprocess")):
            self.say("python_import_time_io", name)
        if name == "type" and len(node.args) == 3:
            self.say("python_dynamic_class_creation", self.where)
        head, _, method = name.rpartition(".")
        if self.where != MODULE and head in self.globals_ and method in CHANGES:
            self.say("python_mutated_module_global", self.where, head)
        self.generic_visit(node)

    def visit_Assign(self, node) -> None:
        for t in node.targets:
            if isinstance(t, ast.Subscript):
                name = dotted(t.value.func) if isinstance(t.value, ast.Call) else dotted(t.value)
                if isinstance(t.value, ast.Call) and name == "globals":
                    self.say("python_globals_subscript_assignment", self.where)
                elif self.where != MODULE and name in self.globals_:
                    self.say("python_mutated_module_global", self.where, name)
        self.generic_visit(node)

    def visit_Compare(self, node) -> None:
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, (ast.Is, ast.IsNot)) and isinstance(right, ast.Constant) and isinstance(right.value, (str, int, float, bytes)) and not isinstance(right.value, bool):
                self.say("python_is_literal_comparison", self.where)
            if isinstance(op, (ast.Eq, ast.NotEq)) and isinstance(right, ast.Constant) and right.value is None:
                self.say("python_equality_with_none", self.where)
        self.generic_visit(node)

    def visit_If(self, node) -> None:
        n, now = 0, node
        while id(node) not in self.elifs:
            n += isinstance(now.test, ast.Call) and dotted(now.test.func) == "isinstance"
            if len(now.orelse) != 1 or not isinstance(now.orelse[0], ast.If):
                break
            now = now.orelse[0]
        if n >= MANY["isinstance"]:
            self.say("python_isinstance_chain", self.where, n)
        self.generic_visit(node)

    def visit_Global(self, node) -> None:
        for name in node.names:
            self.say("python_global_statement", self.where, name)

    def visit_Import(self, node) -> None:
        self.edges += [("imports", [a.name]) for a in node.names]

    def visit_ImportFrom(self, node) -> None:
        module = "." * node.level + (node.module or "")
        self.edges.append(("imports", [module]))
        if any(a.name == "*" for a in node.names):
            self.say("python_star_import", module)


def python_facts(text: str) -> tuple[list[Row], list[Row]]:
    found = PythonFacts(ast.parse(text))
    return found.rows, found.edges


# ---------------------------------------------------------------- languages with braces

MASKED = re.compile(r"""//[^\n]*|/\*.*?\*/|r(\#*)".*?"\1|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'""", re.S)


def masked(text: str) -> str:
    """Same length, same lines; comments and the insides of strings are blanks."""
    def blank(m: re.Match) -> str:
        s = m[0]
        kept = re.sub(r"[^\n]", " ", s)
        return kept if s.startswith("/") else s[0] + kept[1:-1] + s[-1] if len(s) > 1 else s
    return MASKED.sub(blank, text)


def closing(code: str, at: int, opens: str = "{", closes: str = "}") -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.finditer(f"[{re.escape(opens + closes)}]", code[at:]):
        depth += 1 if m[0] == opens else -1
        if depth == 0:
            return at + m.end()
    return len(code)


def split_parameters(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*out, now] if p.strip()]


def functions(code: str, head: re.Pattern) -> Iterator[tuple[re.Match, list[str], str, str, int]]:
    """(match, parameters, what stands before the body, body, place) of each function."""
    for m in head.finditer(code):
        end = closing(code, m.end() - 1, "(", ")")
        brace = re.compile(r"[{;]").search(code, end)
        if brace and brace[0] == "{":
            stop = closing(code, brace.start())
            yield m, split_parameters(code[m.end():end - 1]), code[end:brace.start()], code[brace.start():stop], m.start()


RUST_FN = re.compile(r"(?P<pub>\bpub(?:\([^)]*\))?\s+)?(?:(?:const|unsafe|extern\s*\"[^\"]*\")\s+)*(?P<async>async\s+)?(?:unsafe\s+)?\bfn\s+(?P<name>\w+)\s*(?:<[^({]*>)?\s*\(")
BLOCKING = ("std::thread::sleep", "thread::sleep", "std::fs::read", "std::fs::write", "fs::read_to_string", "fs::write")
CALL = re.compile(r"(?<![\w!])([A-Za-z_][\w:]*)\s*\(")
KEYWORDS = {"if", "while", "for", "match", "return", "fn", "loop", "switch", "catch", "function", "guard", "in", "as", "Some", "Ok", "Err", "None"}


def before_lines(text: str, at: int) -> list[str]:
    """The attribute, comment and blank lines right before a place, nearest first."""
    lines = text[:text.rfind("\n", 0, at) + 1].split("\n")[:-1]
    out = []
    for line in reversed(lines):
        if not line.strip() or line.lstrip().startswith(("#", "//", "@")):
            out.append(line.strip())
        else:
            break
    return out


def rust_facts(text: str) -> tuple[list[Row], list[Row]]:
    code, rows, edges = masked(text), [], []
    say = lambda p, *a: rows.append((p, [str(x) for x in a]))
    for m, params, after, body, at in functions(code, RUST_FN):
        name, lead = m["name"], before_lines(text, m.start())
        is_test = any(re.match(r"#\[(\w+::)?test\b", x) for x in lead)
        edges.append(("defines_test" if is_test else "defines_fn", [name]))
        edges += [("calls", [name, c]) for c in dict.fromkeys(CALL.findall(body)) if c not in KEYWORDS]
        if re.search(r"->\s*Result\s*<[^,]*,\s*String\s*>", after):
            say("function_returns_result_string", name)
        own = [p for p in params if not re.fullmatch(r"(&\s*(?:'\w+\s+)?)?(?:mut\s+)?self(?:\s*:.*)?", p)]
        for p in own:
            param, _, kind = p.partition(":")
            param, kind = param.replace("mut ", "").strip(), kind.strip()
            say("function_param_type", name, param, kind)
            if re.match(r"&(?:'\w+\s+)?(?:mut\s+)?Vec\s*<", kind):
                say("function_param_is_vec_ref", name, param)
            if re.match(r"&(?:'\w+\s+)?(?:mut\s+)?Box\s*<", kind):
                say("function_param_is_box_ref", name, param)
        clones, lets, muts = body.count(".clone()"), len(re.findall(r"\blet\b", body)), len(re.findall(r"\blet\s+mut\b", body))
        if clones:
            say("function_clone_count", name, clones)
        for predicate, n, least in (("function_param_count_high", len(own), "rust_params"), ("function_clone_count_high", clones, "clones"), ("function_let_binding_count_high", lets, "lets"), ("function_let_mut_count_high", muts, "let_muts")):
            if n >= MANY[least]:
                say(predicate, name, n)
        if m["pub"]:
            say("function_is_public", name)
            if not any(x.startswith("///") for x in lead):
                say("pub_fn_without_doc_comment", name)
        if m["async"]:
            say("function_is_async", name)
            for call in BLOCKING:
                if re.search(rf"(?<![\w:]){re.escape(call)}\s*\(", body):
                    say("rust_async_blocking_call", name, call)
            for guard in re.finditer(r"\blet\s+(?:mut\s+)?(\w+)\s*=[^;]*\.(?:lock|read|write)\(\)[^;]*;", body):
                rest = body[guard.end():]
                if ".await" in rest.split(f"drop({guard[1]})")[0]:
                    say("rust_sync_lock_guard_across_await", name, guard[1])
        if is_test and not re.search(r"\bassert\w*!|\bpanic!|\.unwrap\(|\.expect\(|\bshould_panic", body + " ".join(lead)):
            say("test_without_assertion", name)
        for m2 in re.finditer(r"\bunsafe\s*\{", body):
            if not any("SAFETY:" in x for x in before_lines(text, code.index(body, at) + m2.start())):
                say("rust_unsafe_without_safety_comment", name)
        if re.search(r"\.eval(?:_\w+)?(?:::<[^>]*>)?\(\s*\"", body):
            say("engine_eval_string_literal", name)
    for m in re.finditer(r"#\[derive\(([^)]*)\)\](?:\s*#\[[^\]]*\])*\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)", code):
        for d in split_parameters(m[1]):
            say("struct_derives", m[2], d)
    for m in re.finditer(r"\bimpl(?:\s*<[^{]*?>)?\s+([\w:]+)(?:<[^{]*?>)?\s+for\s+([\w:]+)", code):
        say("rust_trait_impl", m[1].split("::")[-1], m[2].split("::")[-1])
        if m[1].split("::")[-1] == "Drop" and (b := code.find("{", m.end())) >= 0:
            for call in re.findall(r"\b(panic!|unwrap|expect|unreachable!|todo!)\s*\(", code[b:closing(code, b)]):
                say("rust_panic_in_drop", m[2].split("::")[-1], call)
    for m in re.finditer(r"\bstruct\s+(\w+)[^{;(]*\{", code):
        for field in re.findall(r"\b(\w*_id|id)\s*:\s*(?:u32|u64|i32|i64|usize|String)\b", code[m.end():closing(code, m.end() - 1)]):
            say("rust_primitive_id_field", m[1], field)
    if re.search(r"\bRc\s*<\s*RefCell\s*<", code):
        say("rust_rc_refcell_type", MODULE)
    edges += [("imports", [x]) for x in re.findall(r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", code)]
    return rows, edges


TS_FN = re.compile(r"\b(?P<async>async\s+)?function\s*\*?\s*(?P<name>\w+)\s*(?:<[^({]*>)?\s*\(")
TS_ARROW = re.compile(r"\b(?:const|let)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?P<async>async\s+)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={]+)?=>)")


def typescript_facts(text: str) -> tuple[list[Row], list[Row]]:
    code, rows, edges = masked(text), [], []
    say = lambda p, *a: rows.append((p, [str(x) for x in a]))
    spans = []
    for head in (TS_FN, TS_ARROW):
        for m, params, after, body, at in functions(code, head):
            edges.append(("defines_fn", [m["name"]]))
            edges += [("calls", [m["name"], c]) for c in dict.fromkeys(re.findall(r"(?<![\w.])([A-Za-z_$][\w$.]*)\s*\(", body)) if c not in KEYWORDS]
            spans.append((at, code.index(body, at) + len(body), m["name"]))
            if len(params) >= MANY["ts_params"]:
                say("ts_function_param_count_high", m["name"], len(params))
            if m["async"]:
                say("function_is_async", m["name"])
    per: dict[tuple[str, str], int] = {}
    for predicate, pattern, source in (("ts_explicit_any", r":\s*any\b|\bas\s+any\b|<any>", code), ("ts_non_null_assertion", r"[\w)\]]!(?=[.;,)\[\s])(?!\s*=)", code),
                                       ("ts_console_log_call", r"\bconsole\.log\s*\(", code), ("ts_suppression_comment", r"//\s*@ts-(?:ignore|nocheck|expect-error)|//\s*eslint-disable", text)):
        for m in re.finditer(pattern, source):
            inside = min(((e - s, n) for s, e, n in spans if s <= m.start() < e), default=(0, MODULE))[1]
            per[predicate, inside] = per.get((predicate, inside), 0) + 1
    for (predicate, name), n in per.items():
        say(predicate, name, n)
    edges += [("imports", [x]) for x in re.findall(r"""(?m)^\s*(?:import|export)\b[^;\n]*?from\s+["']([^"']+)["']""", text)]
    return rows, edges


SWIFT_FN = re.compile(r"\bfunc\s+(?P<name>\w+)\s*(?:<[^({]*>)?\s*\(")


def swift_facts(text: str) -> tuple[list[Row], list[Row]]:
    code, rows, edges = masked(text), [], []
    for m, _, after, body, _ in functions(code, SWIFT_FN):
        edges.append(("defines_test" if m["name"].startswith("test") else "defines_fn", [m["name"]]))
        edges += [("calls", [m["name"], c]) for c in dict.fromkeys(CALL.findall(body)) if c not in KEYWORDS]
        unwraps = len(re.findall(r"[\w)\]]!(?!=)", body))
        rows += [("function_uses_force_unwrap", [m["name"], str(unwraps)])] if unwraps else []
        rows += [("function_throws", [m["name"]])] if re.search(r"\bthrows\b", after) else []
        rows += [("function_is_async", [m["name"]])] if re.search(r"\basync\b", after) else []
    edges += [("imports", [x]) for x in re.findall(r"(?m)^\s*import\s+([\w.]+)", code)]
    return rows, edges


READERS: dict[str, Callable[[str], tuple[list[Row], list[Row]]]] = {"python": python_facts, "rust": rust_facts, "typescript": typescript_facts, "swift": swift_facts}


def extract(files: DataFrame) -> DataFrame:
    """files (file, text) as rows (file, language, kind, predicate, args): facts (kind ast) and edges (kind edge), whose
    first argument is the file. Files in other languages give nothing."""
    def run(batches):
        for pdf in batches:
            rows = []
            for file, text, language in zip(pdf["file"], pdf["text"], pdf["language"]):
                try:
                    facts, edges = READERS[language](text)
                except (SyntaxError, ValueError, RecursionError) as e:
                    facts, edges = [("unparsable", [type(e).__name__])], []
                rows += [(file, language, kind, p, [file, *a]) for kind, some in (("ast", facts), ("edge", edges)) for p, a in some]
            yield pd.DataFrame(rows, columns=["file", "language", "kind", "predicate", "args"])
    extension = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension)
    return files.select("file", "text", known.alias("language")).where("language IS NOT NULL AND text IS NOT NULL").mapInPandas(
        run, "file string, language string, kind string, predicate string, args array<string>")


def ast_facts(files: DataFrame) -> DataFrame:
    """(file, predicate, args) of the syntax facts, as audits take them."""
    return extract(files).where("kind = 'ast'").select("file", "predicate", "args")


def graph_edges(files: DataFrame) -> DataFrame:
    """Base edges (p, a, src, d) of the code graph."""
    return extract(files).where("kind = 'edge'").select(F.col("predicate").alias("p"), F.col("args").alias("a"), F.col("file").alias("src"), F.lit(False).alias("d")).distinct()
