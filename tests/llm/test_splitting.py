from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import splitting


def check(data: bytes, cuts, limit, overlap):
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data)
    for lo, hi in cuts:
        data[lo:hi].decode()
        assert hi - lo <= limit
    for (_, end), (start, end2) in zip(cuts, cuts[1:]):
        assert end - overlap <= start <= end - overlap + 3 and end2 > end


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é一\U0001f525\n\t{}#:", max_size=900))
def test_pieces_cover_and_overlap(text):
    data = text.encode()
    check(data, splitting.pieces(data, 60, 10), 60, 10)


def test_cuts_between_declarations():
    one = "def f{0}(a):\n" + "    x = a + {0}\n" * 12 + "\n"
    text = "class A:\n" + "".join("    " + one.format(i).replace("\n    ", "\n        ").rstrip() + "\n\n" for i in range(40))
    data = text.encode()
    cuts = splitting.pieces(data, 1500, 100)
    check(data, cuts, 1500, 100)
    assert all(data[hi:].lstrip().startswith(b"def f") for _, hi in cuts[:-1])


def test_comments_stay_with_their_declaration():
    text = "".join(f"// about {i}\n// more\nfn f{i}() {{\n" + "    call();\n" * 9 + "}\n\n" for i in range(30))
    data = text.encode()
    assert all(data[hi:].startswith(b"// about") for _, hi in splitting.pieces(data, 700, 50)[:-1])


def test_lines_then_characters():
    data = ("x = 1\n" * 30 + "é" * 400 + "\n").encode()
    cuts = splitting.pieces(data, 100, 10)
    check(data, cuts, 100, 10)


def test_deep_nesting_is_no_recursion_problem():
    data = "".join(" " * i + f"if a{i} {{\n" for i in range(300)).encode()
    check(data, splitting.pieces(data, 200, 20), 200, 20)


def test_headings_are_kept_with_their_sections():
    text = "".join(f"# Part {i}\n\n" + "".join(f"## Point {i}.{k}\n\nSome words here.\n\n- one\n- two\n\n" for k in range(3)) for i in range(20))
    data = text.encode()
    cuts = splitting.pieces(data, 600, 40, True)
    check(data, cuts, 600, 40)
    assert all(data[hi:].startswith(b"# Part") for _, hi in cuts[:-1])
    tight = splitting.pieces(data, 150, 10, True)
    check(data, tight, 150, 10)
    assert all(data[hi:].startswith((b"# Part", b"## Point")) for _, hi in tight[:-1])


def test_siblings_merge_before_their_parents():
    inner = "    fn a{0}() {{\n" + "        call();\n" * 4 + "    }}\n"
    text = "mod one {\n" + "".join(inner.format(i) for i in range(8)) + "}\n" + "fn after() {\n    x();\n}\n" * 3
    data = text.encode()
    cuts = splitting.pieces(data, 420, 20)
    check(data, cuts, 420, 20)
    assert all(data[hi:].lstrip().startswith((b"fn", b"mod", b"}")) for _, hi in cuts[:-1])


def test_reassembled(spark):
    text = "é = 1\n" * 3000
    df = spark.createDataFrame([("a", datetime(2024, 1, 1), "py", 1, 3000, text)], "id string, ingested_at timestamp, language string, start_line long, end_line long, raw_text string")
    r = splitting.reassembled(splitting.split_nodes(df)).first()
    assert r.largest <= 6000 and r.pieces == 4 and r.digest == hashlib.md5(text.encode()).hexdigest()


def test_table(spark):
    big, small = "a = 1\r\n" * 2000, "a = 1\n"
    t = [datetime(2024, 1, d) for d in (1, 2)]
    rows = [("new", t[1], 11, 2010, big), ("new", t[0], 1, 1, small), ("old", t[0], 1, 2000, big), ("old", t[1], 1, 1, small), ("nul", t[0], 1, 2000, big), ("nul", t[1], 1, 1, None), (None, t[0], 1, 1, big), ("lines", None, None, None, big), ("lines", None, None, None, big)]
    df = spark.createDataFrame(rows, "id string, ingested_at timestamp, start_line long, end_line long, raw_text string").withColumn("language", F.lit(None).cast("string")).withColumn("text", F.lit(1)).withColumn("piece", F.lit(2))
    out = splitting.split_nodes(df).collect()
    assert {r.id for r in out} == {"new", "lines"}
    new = sorted((r for r in out if r.id == "new"), key=lambda r: r.piece)
    assert [r.piece for r in new] == list(range(1, len(new) + 1)) and all(r.pieces == len(new) for r in new)
    assert new[0].start_line == 11 and new[-1].end_line == 2010 and all(len(r.text.encode()) <= 6000 for r in new)
    assert all(b.start_line <= a.end_line + 1 for a, b in zip(new, new[1:]))
    assert all(r.start_line is None and r.end_line is None for r in out if r.id == "lines")
    assert splitting.split_nodes(df.limit(0)).count() == 0


def test_parameters():
    with pytest.raises(ValueError):
        splitting.split_nodes(None, 10, 200)
