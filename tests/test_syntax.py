"""Syntax facts of small sources in each language."""

from rulelake.operators import audit
from rulelake.sources import syntax

PYTHON = '''
import os, json
from x.y import *
CACHE = {}
open("at import")
class A: pass
class B(A): pass
class C(B): pass
class D(C, A):
    items = []
    def __new__(cls): return None
    def a(self): return self.inner.a()
    def b(self): return self.inner.b()
    def c(self): return self.inner.c()
    def d(self): return self.inner.d()
class LogMixin:
    def __init__(self): pass
class It:
    def __iter__(self): return self
    def __next__(self): raise StopIteration
def f(a, b=[], c=make(), *, d=1, e=2, g=3):
    """doc"""
    global CACHE
    CACHE["x"] = 1
    CACHE.update(a)
    globals()["z"] = 1
    try:
        print(a == None)
    except:
        pass
    if isinstance(a, int): return 1
    elif isinstance(a, str): return 2
    elif isinstance(a, list): return 3
    return a is "x"
async def _g(): return type("T", (), {})
def test_nothing(): f(1)
'''
RUST = '''
use std::fs;
/// documented
pub fn a(x: &Vec<u8>, y: &Box<i32>) -> Result<(), String> { let mut q = x.clone(); b(q); Ok(()) }
pub async fn b(s: String) { let g = M.lock().unwrap(); std::thread::sleep(d); go().await; }
fn c(a: i32, b: i32, c: i32, d: i32, e: i32, f: i32) { unsafe { x() } // .clone() "
    let s = "x.clone() { ";
    // SAFETY: fine
    unsafe { y() } }
#[derive(Debug, Clone)]
pub struct S { user_id: u64, cell: Rc<RefCell<i32>> }
impl Drop for S { fn drop(&mut self) { self.x.unwrap(); } }
#[test]
fn t() { b(1); }
'''
TS = '''
import { x } from "./lib";
export function f(a: any, b: number, c: string, d: Date, e: any) { console.log(a!.b); return g(b); }
const h = async (q: string) => { return "as any"; };
// @ts-ignore
'''
SWIFT = "import Foundation\nfunc go(x: Int) async throws -> Int { return y!.z + run(x) }\nfunc testIt() { }\n"


def test_extraction(spark):
    files = [("a.py", PYTHON), ("b.rs", RUST), ("c.ts", TS), ("d.swift", SWIFT), ("bad.py", "def ("), ("e.md", "# x"), ("f.py", None), ("g.rs", "")]
    df = spark.createDataFrame(files, "file string, text string")
    got = {(r.kind, r.predicate, *r.args) for r in syntax.extract(df).collect()}
    want = """python_star_import x.y|python_import_time_io open|python_inheritance_depth D 3|python_multiple_inheritance D 2|python_mutable_class_attribute D items|python_new_override D __new__
python_static_delegation_wrapper D inner 4|python_mixin_with_init LogMixin|python_container_is_own_iterator It|python_function_param_count_high f 6|python_mutable_default_arg f b|python_call_in_default_arg f c make
python_global_statement f CACHE|python_mutated_module_global f CACHE|python_globals_subscript_assignment f|python_print_call f|python_equality_with_none f|python_bare_except f|python_exception_handler_passes f
python_isinstance_chain f 3|python_is_literal_comparison f|python_dynamic_class_creation _g|function_is_async _g|test_without_assertion test_nothing|python_function_missing_docstring test_nothing""".replace("\n", "|").split("|")
    found = {(p, *a) for k, p, f, *a in got if k == "ast" and f == "a.py"}
    for w in want:
        assert any(x[:len(w.split())] == tuple(w.split()) for x in found), w
    assert ("python_function_missing_docstring", "f") not in found
    rust = {(p, *a) for k, p, f, *a in got if k == "ast" and f == "b.rs"}
    assert {("function_returns_result_string", "a"), ("function_param_is_vec_ref", "a", "x"), ("function_param_is_box_ref", "a", "y"), ("function_clone_count", "a", "1"), ("function_is_public", "a"),
            ("pub_fn_without_doc_comment", "b"), ("function_is_async", "b"), ("rust_async_blocking_call", "b", "std::thread::sleep"), ("rust_sync_lock_guard_across_await", "b", "g"),
            ("function_param_count_high", "c", "6"), ("rust_unsafe_without_safety_comment", "c"), ("struct_derives", "S", "Clone"), ("rust_trait_impl", "Drop", "S"), ("rust_panic_in_drop", "S", "unwrap"),
            ("rust_primitive_id_field", "S", "user_id"), ("rust_rc_refcell_type", "<module>"), ("test_without_assertion", "t")} <= rust
    assert ("pub_fn_without_doc_comment", "a") not in rust and not any(x[:2] == ("function_clone_count", "c") for x in rust) and sum(x[0] == "rust_unsafe_without_safety_comment" for x in rust) == 1
    ts = {(p, *a) for k, p, f, *a in got if k == "ast" and f == "c.ts"}
    assert ts == {("ts_function_param_count_high", "f", "5"), ("ts_explicit_any", "f", "2"), ("ts_non_null_assertion", "f", "1"), ("ts_console_log_call", "f", "1"), ("function_is_async", "h"), ("ts_suppression_comment", "<module>", "1")}
    swift = {(p, *a) for k, p, f, *a in got if k == "ast" and f == "d.swift"}
    assert swift == {("function_uses_force_unwrap", "go", "1"), ("function_throws", "go"), ("function_is_async", "go")}
    assert ("ast", "unparsable", "bad.py", "SyntaxError") in got and not any(x[2] in ("e.md", "f.py", "g.rs") for x in got)
    edges = {(r.p, *r.a) for r in syntax.graph_edges(df).collect()}
    assert {("imports", "a.py", "x.y"), ("defines_fn", "a.py", "f"), ("defines_method", "a.py", "D.a"), ("calls", "a.py", "D.a", "self.inner.a"), ("defines_test", "b.rs", "t"), ("calls", "b.rs", "a", "b"),
            ("imports", "c.ts", "./lib"), ("calls", "c.ts", "f", "g"), ("calls", "d.swift", "go", "run")} <= edges
    rule = audit.union_rule(syntax.ast_facts(df), [("python_bare_except", ["?f", "?fn"]), ("python_print_call", ["?f", "?fn"])])
    assert {(r.file, r.predicate) for r in rule.collect()} == {("a.py", "python_bare_except"), ("a.py", "python_print_call")}
