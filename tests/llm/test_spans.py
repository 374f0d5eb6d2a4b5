"""Shared spans against brute force, through both ways of verification."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from skein.llm import spans

L = 30
SCHEMA = "id string, repo_id string, raw_text string, ingested_at timestamp, extra int, m string"


def brute(rows, length):
    now = {}
    for i, r, t, at, *_ in rows:
        if i is not None and (i not in now or (at or datetime.min) >= (now[i][2] or datetime.min)):
            now[i] = (r, t, at)
    ok = {i: (r, t) for i, (r, t, _) in now.items() if r is not None and t is not None}
    grams = {i: {t[k : k + length] for k in range(len(t) - length + 1)} for i, (r, t) in ok.items()}
    pairs, cover = set(), {}
    for i in ok:
        marked = set()
        for j in ok:
            if ok[i][0] != ok[j][0] and (both := grams[i] & grams[j]):
                pairs.add((min(i, j), max(i, j)))
                t = ok[i][1]
                for k in range(len(t) - length + 1):
                    if t[k : k + length] in both:
                        marked.update(range(k, k + length))
        if marked:
            cover[i] = len(marked)
    return pairs, cover


def table(seed, n=60):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdé一\n") for _ in range(k))
    shared = [word(rng.randrange(L - 8, 2 * L)) for _ in range(6)] + ["z" * 45, "ab" * 40]
    rows = []
    for i in range(n):
        text = word(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            text += rng.choice(shared) + word(rng.randrange(40))
        rows.append((f"n{i}", f"r{rng.randrange(4)}", text, datetime(2024, 1, 1) + timedelta(hours=i), i, "clash"))
    rows += [rows[3], rows[4], ("n5", "r1", "short", datetime(2025, 1, 1), 0, ""), ("nul", "r1", None, None, 0, ""), (None, "r2", shared[0] * 2, None, 0, ""), ("norepo", None, shared[0] * 2, None, 0, ""), ("copy1", "r1", shared[1] * 2, None, 0, ""), ("copy2", "r2", shared[1] * 2, None, 0, "")]
    return rows


@pytest.mark.parametrize(("seed", "pairwise", "batches", "few"), [(1, 64, 4, 0), (2, 0, 2, 100_000), (3, 3, 5, 0), (4, 64, 1, 100_000)])
def test_pairs_and_coverage(spark, monkeypatch, seed, pairwise, batches, few):
    monkeypatch.setattr(spans, "PAIRWISE", pairwise)
    monkeypatch.setattr(spans, "BROADCAST_TEXTS", few)
    rows = table(seed)
    now, v = spans.shared_spans(spark.createDataFrame(rows, SCHEMA), L, batches)
    pairs, cover = brute(rows, L)
    assert {(r.id_a, r.id_b) for r in spans.node_pairs(now, v).collect()} == pairs
    got = spans.coverage(now, v).collect()
    assert {r.id: r.shared_chars for r in got} == cover
    assert {r.id: r.partners for r in got} == {i: sum(i in p for p in pairs) for i in cover}


def test_empty_and_nothing_shared(spark):
    for rows in ([], [("a", "r", "x" * 50, None, 0, ""), ("b", "r", "x" * 50, None, 0, "")]):
        now, v = spans.shared_spans(spark.createDataFrame(rows, SCHEMA), L)
        assert spans.node_pairs(now, v).count() == 0 and spans.coverage(now, v).count() == 0


def test_winnowing_meets_every_shared_span():
    rng = random.Random(9)
    for _ in range(200):
        s = "".join(rng.choice("abc") for _ in range(L))
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(2))
        x, y = a + s + b, b[::-1] + s + a[::-1]
        assert set(spans.fingerprints(x, L)[0]) & set(spans.fingerprints(y, L)[0])
    assert len(spans.fingerprints("x" * (L - 1), L)[0]) == 0


def test_sliding_minimum():
    a = np.array([5, 3, 9, 1, 7, 7, 2], dtype=np.uint64)
    for w in range(1, 8):
        assert spans._sliding_min(a, w).tolist() == [min(a[i : i + w].tolist()) for i in range(len(a) - w + 1)]
