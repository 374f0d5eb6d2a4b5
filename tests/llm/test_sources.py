from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F

from skein.llm import sources

SCHEMA = "id string, repo_id string, file_path string, symbol_type string, symbol_name string, raw_text string, source_start_byte long, ingested_at timestamp"


def hand(rng):
    w = lambda: rng.choice(["pool", "index", "cursor", "layer", "ring", "probe"]) + "_" + rng.choice(["state", "owner", "query", "value"])
    return f"def {w()}(self, {w()}):\n" + "".join(f"    {w()} = {w()}.run({w()}, {rng.randrange(99)})\n    if {w()} is None:\n        return {w()}\n" for _ in range(rng.randrange(4, 9)))


def made(rng):
    return [f"def get_field_{i}(self):\n    return self._field_{i}_{i}\n" for i in range(rng.randrange(8, 15))]


def small(rng):
    return "def a(" + ",".join(rng.choice("xyz") + rng.choice("pq") for _ in range(4)) + "):" + "".join(f"{rng.choice('abc')}={rng.choice('xyz')}[{rng.randrange(99)}];" for _ in range(200))


def table(seed=1):
    rng = random.Random(seed)
    rows, truth, k = [], {}, 0
    for f in range(300):
        repo, kind = f"r{f % 5}", rng.choice(["hand"] * 7 + ["made", "small", "made"])
        marked = kind != "hand" and rng.random() < 0.7
        path = f"src/{'gen/' if marked else ''}f{f}.py"
        parts = [hand(rng) for _ in range(5)] if kind == "hand" else made(rng) if kind == "made" else [small(rng)]
        for n, p in enumerate(parts):
            k += 1
            rows.append((f"n{k}", repo, path.replace("/", "\\") if f % 9 == 0 else path, "function", "x", p, n * 1000, datetime(2024, 1, 1)))
        truth[repo, path] = kind != "hand"
    copy = [hand(rng) for _ in range(4)]
    for repo, path in (("r1", "lib/util/thing.py"), ("r2", "src/other.py")):
        for n, p in enumerate(copy):
            rows.append((f"c{repo}{n}", repo, path, "function", "x", p, n * 1000, datetime(2024, 1, 1)))
        truth[repo, path] = True
    rows.append(("v", "r1", "vendor/x/y.py", "function", "x", hand(rng), 0, None))
    rows.append(("p", "r1", "src/vendor_portal/y.py", "function", "x", hand(rng), 0, None))
    rows.append(("h", "r1", "src/h.py", "function", "x", "# tinylib 1.2.3 - https://tinylib.example/ - distributed under the MIT licence\n" + hand(rng), 0, None))
    truth |= {("r1", "vendor/x/y.py"): True, ("r1", "src/vendor_portal/y.py"): False, ("r1", "src/h.py"): True}
    rows += rows[:20] + [("nul", "r1", None, "function", "x", "t", 0, None), (None, "r1", "src/q.py", "function", "x", "t", 0, None)]
    return rows, truth


def test_hand_written_files_remain(spark):
    rows, truth = table()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("chance", F.lit("clash")).withColumn("bytes", F.lit(1))
    got = {(r.repo_id, r.path): not r.by_hand for r in sources.classify(df).collect()}
    assert got.keys() == truth.keys()
    assert sum(got[k] == truth[k] for k in truth) / len(truth) >= 0.98
    for k in (("r1", "vendor/x/y.py"), ("r1", "src/vendor_portal/y.py"), ("r1", "src/h.py"), ("r1", "lib/util/thing.py"), ("r2", "src/other.py")):
        assert got[k] == truth[k]


def test_copies_are_learned_from_notices(spark):
    rng, rows, truth = random.Random(4), [], {}
    for f in range(240):
        copy, noticed = [hand(rng) for _ in range(3)], rng.random() < 0.4
        homes = [(f"r{f % 6}", f"src/f{f}.py")] if f % 4 else [(f"r{f % 6}", f"src/f{f}.py"), (f"r{f % 6 + 1}", f"lib/g{f}.py")]
        for i, (repo, path) in enumerate(homes):
            for n, t in enumerate(copy):
                notice = "# tinylib 1.2.3 - https://tinylib.example/ - distributed under the MIT licence\n" if len(homes) > 1 and n == 0 and noticed else ""
                rows.append((f"{f}.{i}.{n}", repo, path, "function", "x", notice + t, n * 1000, datetime(2024, 1, 1)))
            truth[repo, path] = len(homes) > 1
    got = {(r.repo_id, r.path): r for r in sources.classify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[k].third_party == v for k, v in truth.items()) / len(truth) >= 0.97
    assert any(got[k].third_party and not got[k].copy_notice for k in truth)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([("a", "r", "gen/a.py", "function", "x", "def f(): pass", 0, None), ("b", "r", "gen/b.py", "function", "x", None, 0, None)], SCHEMA)
    assert {(r.path, r.by_hand) for r in sources.classify(df).collect()} == {("gen/a.py", False), ("gen/b.py", False)}
    assert sources.classify(df.limit(0)).count() == 0


def test_notices_are_read_from_leading_comments_only():
    assert sources._GENERATED.search(sources.notice_text("// Code generated by x. DO NOT EDIT.\nfn a() {}"))
    assert sources._GENERATED.search(sources.notice_text('class A(B):\n    """@generated by x"""\n    pass'))
    assert not sources._GENERATED.search(sources.notice_text('fn a() {\n    emit("// Code generated by %s. DO NOT EDIT.");\n}'))
