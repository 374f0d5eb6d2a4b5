from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.llm import docs

GOOD = "Reads the whole table and returns every row it holds."


def own(lang, text):
    c = docs.own_comment(lang, text)
    return c is not None and docs.words(docs.description(c, lang)[0]) >= docs.MIN_WORDS


@pytest.mark.parametrize(("lang", "text", "want"), [
    ("py", f'def f(a, b=":)"):\n    """{GOOD}"""\n', True),
    ("py", f"@d('x')\nasync def f(\n    a,\n) -> int:\n    # note\n    r'''{GOOD}'''\n", True),
    ("py", f'def f():\n    x = """{GOOD}"""\n', False),
    ("py", f'def f():\n    def g():\n        """{GOOD}"""\n', False),
    ("py", f"# {GOOD}\ndef f():\n    pass\n", False),
    ("py", f'def f():\n    f"""{GOOD}"""\n', False),
    ("py", 'def f(a):\n    """\n    Args:\n        a: one two three four five six seven\n\n    Returns:\n        one two three four five six\n    """\n', False),
    ("py", 'def f(a):\n    """Parameters\n    ----------\n    a : int\n        one two three four five six\n    """\n', False),
    ("py", 'def f(a):\n    """:param a: one two three four five six\n    :returns: one two three four five six\n    """\n', False),
    ("py", f'def f(a):\n    """Short.\n\n    Args:\n        a: x\n\n    {GOOD}\n    """\n', True),
    ("ts", f"/** {GOOD} */\nfunction f() {{}}", True),
    ("ts", f"// {GOOD}\nfunction f() {{}}", False),
    ("ts", f"/* {GOOD} */\nfunction f() {{}}", False),
    ("ts", "/**\n * @param a - one two three four five six\n * @returns one two three four five six\n */\nf() {}", False),
    ("ts", f"/**\n * @description {GOOD}\n */\nf() {{}}", True),
    ("tsx", f"/** {GOOD} */\n@Dec({{ a: 1 }})\nfoo() {{}}", True),
    ("rs", f"/// {GOOD}\n#[inline]\nfn f() {{}}", True),
    ("rs", f"//// {GOOD}\nfn f() {{}}", False),
    ("rs", f'#[doc = "{GOOD}"]\nfn f() {{}}', True),
    ("rs", f"fn f() {{\n    //! {GOOD}\n}}", True),
    ("rs", "/// # Errors\n///\n/// Fails when the node has no parser left to give.\nfn f() {}", False),
    ("cpp", f"/*! {GOOD} */\nint f() {{}}", True),
    ("c", f"//! {GOOD}\nint f() {{}}", True),
    ("h", "/**\n * \\return the value of the one that was found there\n */\nint f();", False),
    ("rb", f"# {GOOD}\ndef f\nend", True),
    ("rb", "# rubocop:disable Metrics/AbcSize, Metrics/MethodLength, Style/GuardClause, Style/X\ndef f\nend", False),
    ("rb", "# @param a [Integer] one two three four five six\n# @return [Array] one two three four five\ndef f(a)\nend", False),
    ("rb", f"=begin\n{GOOD}\n=end\ndef f\nend", True),
    ("py", 'def f():\n    """TODO: write a proper description of this once it is stable"""\n', False),
    ("ts", "/** Copyright (c) the early team. Licensed under the terms in the LICENCE file. */\nf() {}", False),
    ("ts", "/**\n * const a = b.c(d);\n * if (a > 3) {\n *   run(a, b, c);\n * }\n */\nf() {}", False),
    ("ts", f"/**\r\n * {GOOD}\r\n */\r\nf() {{}}", True),
    ("zz", f"/** {GOOD} */", False),
    (None, "", False),
])
def test_own_description(lang, text, want):
    assert own(lang, text) is want


def test_bases():
    assert docs.bases_of("py", "class A(B, m.C, metaclass=M):") == ["B", "C"]
    assert docs.bases_of("rb", "class A < B::C\n") == ["C"]
    assert docs.bases_of("ts", "export class A extends B implements C, D {") == ["B", "C", "D"]
    assert docs.bases_of("cpp", "class A : public B, private C {") == ["B", "C"]
    assert docs.bases_of("rs", "impl Tr for S {") == ["Tr"]
    assert docs.bases_of("ts", "class A {") == []
    assert docs.bases_of("py", "class A:\n    class Meta(B):\n        pass\n") == [] and docs.bases_of("py", "# class X(Y):\n@dec(1, [2])\nclass A(base_thing[T], abc.ABC):\n    pass") == ["base_thing", "ABC"]
    assert docs.bases_of("cpp", "// a class c : d {\nclass a : public virtual ns::base_thing<int, K>, other {") == ["base_thing", "other"] and docs.bases_of("cpp", "struct a::b {") == []
    assert docs.bases_of("ts", "export default class A<T extends Z> extends lib.B<T, K[]> implements C<D> {") == ["B", "C"]
    assert docs.bases_of("rs", "impl<T: Clone> fmt::Tr<T> for S<T> {") == ["Tr"] and docs.bases_of("rs", "impl S {") == [] and docs.bases_of("rs", "pub trait T: Sub + Send {") == ["Sub", "Send"]
    assert docs.bases_of("rb", "# class Z < Y\nclass A\n  class B < C\n  end\nend") == [] and docs.bases_of("go", "type a struct {") == [] and docs.bases_of("ts", "interface A extends B, C {") == ["B", "C"]


def test_pairs_inherit_through_bases(spark):
    t = [datetime(2024, 1, d) for d in (1, 2)]

    def row(id_, kind, name, text, start, end, at=t[0], path="f.py"):
        return (id_, at, "r", path, "py", kind, name, start, end, text)

    rows = [
        row("A", "class", "A", "class A:\n", 0, 100), row("A.m", "function", "m", f'def m(self):\n    """{GOOD}"""\n', 10, 50),
        row("B", "class", "B", "class B(A):\n", 200, 300), row("B.m", "function", "m", "def m(self):\n    pass\n", 210, 250), row("B.n", "function", "n", "def n(self):\n    pass\n", 260, 290),
        row("C", "class", "C", "class C(B):\n", 400, 500), row("C.m", "function", "m", "def m(self):\n    pass\n", 410, 450),
        row("X", "class", "X", "class X(Y):\n", 600, 700), row("X.m", "function", "m", "def m(self):\n    pass\n", 610, 650), row("Y", "class", "Y", "class Y(X):\n", 800, 900),
        row("free", "function", "free", f'def free():\n    """{GOOD}"""\n', 1000, 1100), row("free", "function", "free", "def free():\n    pass\n", 1000, 1100, t[1]),
        row("nul", "function", None, None, 1200, 1300), row(None, "function", "q", f'def q():\n    """{GOOD}"""\n', 0, 1), row("A.m", "function", "m", f'def m(self):\n    """{GOOD}"""\n', 10, 50),
    ]
    df = spark.createDataFrame(rows, "id string, ingested_at timestamp, repo_id string, file_path string, language string, symbol_type string, symbol_name string, source_start_byte long, source_end_byte long, raw_text string").withColumn("description", F.lit(0))
    got = {(r.id, r.source_id) for r in docs.pairs(df).collect()}
    assert got == {("A.m", "A.m"), ("B.m", "A.m"), ("C.m", "A.m")}
    assert docs.pairs(df.limit(0)).count() == 0


def test_innermost_class_against_brute_force(spark):
    import random

    rng = random.Random(2)
    classes = [("r", f"f{rng.randrange(3)}", f"c{i}", a, a + rng.choice([1, 7, 64, 300, 5000]), ["B"]) for i in range(60) for a in [rng.randrange(6000)]]
    methods = [(f"m{i}", "r", f"f{rng.randrange(4)}", "n", "", a, a + rng.randrange(60)) for i in range(200) for a in [rng.randrange(7000)]]
    c = spark.createDataFrame(classes, "repo_id string, file_path string, cls string, cs long, ce long, cb array<string>")
    m = spark.createDataFrame(methods, "id string, repo_id string, file_path string, name string, description string, start long, end long")
    want = {}
    for i, r, f, _, _, s, e in methods:
        around = [(cs, cls) for cr, cf, cls, cs, ce, _ in classes if cr == r and cf == f and cs <= s and e <= ce]
        if around:
            want[i] = max(around)[1]
    assert {x.id: x.cls for x in docs._enclosed(m, c).collect()} == want


NODE = "id string, ingested_at timestamp, repo_id string, file_path string, language string, symbol_type string, symbol_name string, source_start_byte long, source_end_byte long, raw_text string"


def _class(rows, name, bases, method="def m(self):\n    pass\n", language="py", header=None, key=None, path="f.py"):
    """A class with a method m, after those of rows."""
    at, key, k = datetime(2024, 1, 1), key or name, len(rows) * 100
    rows.append((key, at, "r", path, language, "class", name, k, k + 90, header or f"class {name}({bases}):\n"))
    rows.append((f"{key}.m", at, "r", path, language, "function", "m", k + 10, k + 50, method))


def test_pairs_inherit_through_any_number_of_levels(spark):
    rows = []
    _class(rows, "K0", "", f'def m(self):\n    """{GOOD}"""\n')
    for i in range(1, 13):
        _class(rows, f"K{i}", f"K{i - 1}")
    _class(rows, "U", "V")
    _class(rows, "V", "U, U")
    got = {r.id: r.source_id for r in docs.pairs(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {f"K{i}.m": "K0.m" for i in range(13)}


def test_pairs_of_bases_that_say_nothing(spark):
    rows = []
    _class(rows, "U", "")
    _class(rows, "V", "U")
    _class(rows, "W", "", f'def m(self):\n    """{GOOD}"""\n')
    assert {(r.id, r.source_id) for r in docs.pairs(spark.createDataFrame(rows, NODE)).collect()} == {("W.m", "W.m")}


def test_pairs_search_the_bases_of_every_declaration(spark):
    rows = []
    _class(rows, "A", "", f'def m(self):\n    """{GOOD}"""\n')
    _class(rows, "B", "")
    _class(rows, "Mid", "A", key="Mid1")
    _class(rows, "Mid", "B", key="Mid2", path="g.py")
    _class(rows, "Low", "Mid")
    got = {r.id: r.source_id for r in docs.pairs(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {"A.m": "A.m", "Mid1.m": "A.m", "Low.m": "A.m"}


def test_pairs_prefer_the_class_of_the_same_file(spark):
    rows = []
    _class(rows, "Base", "", f'def m(self):\n    """{GOOD} Of the first."""\n', key="B1", path="a.py")
    _class(rows, "Base", "", f'def m(self):\n    """{GOOD} Of the second."""\n', key="B2", path="b.py")
    _class(rows, "Low", "Base", key="Low1", path="b.py")
    _class(rows, "Low", "Base", key="Low2", path="c.py")
    got = {r.id: r.source_id for r in docs.pairs(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {"B1.m": "B1.m", "B2.m": "B2.m", "Low1.m": "B2.m", "Low2.m": "B1.m"}


def test_pairs_append_what_a_comment_asks_to_inherit(spark):
    own = ["Opens the lower file and reads every line.", "Counts the middle words of each given line.", "Writes the upper totals into the given table."]
    rows = []
    for name, base, text in (("A", "", own[0]), ("B", "A", own[1] + " {@inheritDoc}"), ("C", "B", own[2] + " {@inheritDoc}"), ("D", "C", None)):
        method = f"/** {text} */\nm() {{}}\n" if text else "m() {}\n"
        _class(rows, name, base, method, "ts", f"class {name} {{" if not base else f"class {name} extends {base} {{")
    got = {r.id: (r.description, r.source_id) for r in docs.pairs(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {"A.m": (own[0], "A.m"), "B.m": (f"{own[1]} {own[0]}", "B.m"), "C.m": (f"{own[2]} {own[1]} {own[0]}", "C.m"), "D.m": (f"{own[2]} {own[1]} {own[0]}", "C.m")}
