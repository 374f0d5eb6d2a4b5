"""Parsers, condensation, imports, tree scanning."""

from __future__ import annotations

from skein.extract import braces, python_source, ruby
from skein.extract.condense import condense
from skein.extract.imports import file_imports
from skein.extract.languages import capped, has_calls
from skein.extract.table import extract_symbols
from skein.functions.text import fnv1a64, fnv1a64_many, prefix_bytes, task_terms
from skein.sources.tree import ignored_names, scan_tree


def names(syms):
    return [(s.kind, s.name) for s in syms]


def test_python():
    src = "class A:\n    def m(self):\n        return f(self.g())\n\nasync def h():\n    pass\n"
    s = python_source.symbols(src)
    assert names(s) == [("class", "A"), ("function", "m"), ("function", "h")]
    assert set(s[1].callees) == {"f", "g"} and s[0].start == 0 and src[s[1].start : s[1].end].startswith("def m")
    assert python_source.symbols("def broken(:") == []


def test_typescript():
    src = """
export class W<T> extends B {
  private static async run(a: number): Promise<void> { if (a) { go(a); } }
  get x(): number { return 1; }
}
interface I { a: string; }
export enum E { A, B }
type T2 = { a: string };
export function f(a: string): void { helper("not(this)"); /* nor(this) */ }
const g = async (x: number) => { return h(x); };
const Memo = React.memo((p) => { return r(p); });
const plain = 5;
"""
    got = names(braces.symbols(src, "ts"))
    for want in [("class", "W"), ("method", "run"), ("method", "x"), ("interface", "I"), ("enum", "E"), ("type", "T2"), ("function", "f"), ("function", "g"), ("function", "Memo")]:
        assert want in got
    assert ("function", "plain") not in got and ("method", "if") not in got
    assert [s.callees for s in braces.symbols(src, "ts") if s.name == "f"] == [["helper"]]


def test_rust():
    src = """
pub struct P<'a> { x: &'a str }
enum K { A }
trait T { fn need(&self); fn given(&self) -> u8 { 1 } }
impl<'a> T for P<'a> { type Out = u8; fn need(&self) { call(self.x); mac!(1) } }
macro_rules! mac { ($x:expr) => { $x } }
pub(crate) async fn free(a: u8) -> Result<(), E> { Ok(()) }
"""
    got = names(braces.symbols(src, "rs"))
    for want in [("struct", "P"), ("enum", "K"), ("trait", "T"), ("impl", "P"), ("function", "need"), ("function", "given"), ("function", "free"), ("macro", "mac")]:
        assert want in got
    assert ("type", "Out") not in got and got.count(("function", "need")) == 1


def test_c_family():
    src = """
#define X(a) { a }
struct fwd;
typedef struct { int a; } one, *two;
class C : public B { public: int get() const { return v_; } ~C() {} bool operator == (const C& o) const { return eq(o); } };
enum class Color { Red };
template <class T> T N::max(T a, T b) { return a > b ? a : b; }
static int main2(int argc, char** argv)
{
    if (argc) { run(argv); }
    return 0;
}
int declared(int);
"""
    got = names(braces.symbols(src, "cpp"))
    for want in [("type", "one"), ("type", "two"), ("class", "C"), ("function", "get"), ("function", "~C"), ("function", "operator=="), ("enum", "Color"), ("function", "N::max"), ("function", "main2")]:
        assert want in got, (want, got)
    assert ("struct", "fwd") not in got and ("function", "declared") not in got and ("function", "if") not in got
    assert braces.special_name("operator  ==") == "operator==" and braces.special_name("A < B >") == "A<B>"


def test_ruby():
    src = "module M\n  class A < B\n    def self.x(a)\n      if a\n        go(a)\n      end\n      list.each do |y|\n        y.run\n      end\n    end\n    def q? = true\n  end\nend\n"
    s = ruby.symbols(src)
    assert names(s) == [("module", "M"), ("class", "A"), ("method", "x"), ("method", "q?")]
    assert "go" in s[2].callees and "run" in s[2].callees


def test_kinds_without_calls():
    assert not has_calls("interface", "ts") and not has_calls("struct", "c") and has_calls("struct", "rs") and has_calls("function", "c")


def test_condense():
    assert condense("int f() { return 1; }", "c") == "int f() { /* ... */ }"
    assert condense("def f(a):\n    x = 1\n    return x", "py") == "def f(a):\n    pass"
    assert condense("def f\n  1\nend", "rb") == "def f\n  # ...\nend"
    assert condense("anything", "zz") == "anything" and condense(None, "py") is None and condense("int x;", "c") == "int x;"


def test_imports(spark):
    files = spark.createDataFrame(
        [("r", "a.py", "py", "from x.y import a, b as c\nimport os.path, sys\n# import no"), ("r", "b.ts", "ts", "import { A, type B as C } from './m';\nimport {\n D } from 'x';"),
         ("r", "c.h", "h", '#include "dir/one.hpp"\n#include <two.h>'), ("r", "d.rb", "rb", "require 'x'"), ("r", "e.rs", "rs", "use a::b;"), ("r", "n.py", "py", None)],
        "repo_id string, file_path string, language string, content string",
    )
    assert {(r.file_path, r.import_name) for r in file_imports(files).collect()} == {("a.py", "a"), ("a.py", "b"), ("a.py", "path"), ("a.py", "sys"), ("b.ts", "A"), ("b.ts", "B"), ("c.h", "one")}


def test_ids_spans_and_cuts(spark):
    files = spark.createDataFrame([("r", "a.py", "x = 1\ndef f():\n    pass\n", 5), ("r", "big.py", "def g():\n    " + "y = 'é'\n    " * 6000, 6), ("r", "none.py", None, 0), ("r", "a.txt", "def f(): pass", 1)], "repo_id string, file_path string, content string, id int")
    got = {r.symbol_name: r for r in extract_symbols(files).collect()}
    f = got["f"]
    assert (f.id, f.start_line, f.start_column, f.end_line) == ("r:a.py:function:f:6", 2, 1, 3)
    assert len(got["g"].raw_text.encode()) <= 50_000 + 2 + len("\n/* ... cut ... */") and len(got) == 2


def test_byte_prefixes():
    assert prefix_bytes("aé", 2) == "a" and prefix_bytes("aé", 2, keep_crossing=True) == "aé" and prefix_bytes("ab", 5) == "ab"
    assert capped("x" * 10) == "x" * 10


def test_fnv():
    assert fnv1a64(b"") == "cbf29ce484222325" and fnv1a64(b"abc") == "e71fa2190541574b"
    texts = ["", "abc", None, "é" * 300, "x" * 5000] + [f"t{i}" * (i % 40) for i in range(100)]
    assert fnv1a64_many(texts) == [None if t is None else fnv1a64(t.encode()) for t in texts]


def test_task_terms():
    assert task_terms("Where does the Foo_Bar call x2y, ab and the REPO?") == ["call", "foo_bar", "x2y"]


def test_tree(spark, tmp_path):
    for p, t in {"a/x.py": "def f(): pass", "node_modules/y.py": "1", ".hid/z.py": "1", "lib/p.min.js": "1", "skip/q.py": "1", "b.rs": "fn g() {}", "Cargo.lock": "", "w.log.py": "1"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / ".gitignore").write_text("skip/\n*.log.py\n# no\n")
    got = {r.file_path: r.language for r in scan_tree(spark, str(tmp_path), "r").collect()}
    assert got == {"a/x.py": "py", "b.rs": "rs"}
    assert "node_modules" in ignored_names(str(tmp_path))
    (tmp_path / ".skein.json").write_text("{}")
    assert ignored_names(str(tmp_path)) == []
    (tmp_path / ".skein.json").write_text('{"ignore": ["a"]}')
    assert {r.file_path for r in scan_tree(spark, str(tmp_path), "r").collect()} == {"node_modules/y.py", "b.rs"}


def _scanned(spark, root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    return {r.file_path for r in scan_tree(spark, str(root), "r").collect()}


def test_tree_takes_back_what_gitignore_negates(spark, tmp_path):
    files = {"src/a.py": "1", "src/in/b.py": "1", "other/c.py": "1", "top.py": "1"}
    assert _scanned(spark, tmp_path / "x", files | {".gitignore": "*\n!src/\n!src/**\n"}) == {"src/a.py", "src/in/b.py"}
    files = {"lib/keep.py": "1", "lib/drop.py": "1", "lib/sub/keep.py": "1", "gone/keep.py": "1"}
    assert _scanned(spark, tmp_path / "y", files | {".gitignore": "lib/*\n!lib/keep.py\ngone/\n!gone/keep.py\n"}) == {"lib/keep.py"}
    files = {"a.py": "1", "b.py": "1", "d/a.py": "1", "!c.py": "1", "q/w/r.py": "1", "q/r.py": "1", "z1.py": "1", "za.py": "1"}
    assert _scanned(spark, tmp_path / "z", files | {".gitignore": "!a.py\n/a.py\n\\!c.py\nq/**/r.py\nb.py \nz[!a-c].py\n"}) == {"d/a.py", "za.py"}


def test_tree_reads_nested_gitignore(spark, tmp_path):
    files = {"a/x.py": "1", "a/gen/y.py": "1", "b/gen/y.py": "1", "a/b/z.py": "1", "b/z.py": "1", "c/z.py": "1"}
    rules = {".gitignore": "z.py\n", "a/.gitignore": "/gen\n", "b/.gitignore": "!z.py\n"}
    assert _scanned(spark, tmp_path, files | rules) == {"a/x.py", "b/gen/y.py", "b/z.py"}
