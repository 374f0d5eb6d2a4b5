from __future__ import annotations

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200))
def test_no_container_overflows(sizes):
    a = np.array(sizes)
    box = packing.harmonic(a, 100)
    room = np.bincount(box, a)
    assert room.max() <= 100 and len(room) == box.max() + 1 and (room > 0).all()
    assert len(room) <= 2 * -(-a.sum() // 100)


def test_pack_keeps_everything(spark):
    rows = [(i, (i * 37) % 3000) for i in range(500)] + [(7, 5), (None, 9), (None, 9), (900, None), (901, 0), (902, 2048), (903, 4096)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("container_id", F.lit("clash"))
    out = packing.pack(df, len(rows)).collect()
    fill, total = defaultdict(int), defaultdict(int)
    for r in out:
        fill[r.container_id] += r.tokens
        total[r.doc_id] += r.tokens
        assert r.start == r.part * 2048
    want = defaultdict(int)
    for k, n in rows:
        want[k] += n or 0
    assert max(fill.values()) <= 2048 and dict(total) == {k: n for k, n in want.items() if n}
    assert sorted(map(tuple, packing.pack(df, len(rows)).collect()), key=str) == sorted(map(tuple, out), key=str)
    parts = defaultdict(int)
    for r in out:
        parts[r.doc_id] += 1
    assert all(parts[k] == 1 for k, n in rows if n and n <= 2048 and k not in (7, None))


def test_little_room_is_left(spark):
    rows = [(i, int(x)) for i, x in enumerate(np.random.default_rng(1).integers(1, 1500, 4000))]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    r = packing.fill_report(packing.pack(df, len(rows))).first()
    assert r.unused < 0.03 and r.containers >= r.least


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.pack(df, 0).count() == 0
    r = packing.fill_report(packing.pack(df, 0)).first()
    assert (r.containers, r.tokens, r.unused) == (0, 0, None)
