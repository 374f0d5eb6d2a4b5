from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from skein.llm import quality

PROSE = ["The index is small, and so it can be kept in memory while the rest is being sorted.", "Nobody in the team could say why the cache was cleared twice before the release.",
         "Wenn die Suche zu groß wird, bleibt der Index stehen und die Tabelle wartet.", "Quand le fichier devient trop grand, la limite attend et le réponse reste ouvert."]


def junk(rng):
    return rng.choice([
        "\n".join(f"- {rng.choice('abcxyz')}_item (#{rng.randrange(999)})" for _ in range(12)), "\n".join(f"key_{i} = {rng.random():.3f}" for i in range(12)),
        "\n".join(f"  at run{i} (src/a_{i}.ts:{i}:4)" for i in range(9)), "best code free graph fast symbol search cheap node tree", "int f(int a) {\n    return g(a) + 1;\n}\n" * 6,
    ])


def documents(n, seed=3):
    rng = random.Random(seed)
    return [(i, (junk(rng), True)) if rng.random() < 0.4 else (i, (" ".join(rng.choice(PROSE) for _ in range(6)), False)) for i in range(n)]


def test_prose_share():
    assert quality.prose_share(" ".join(PROSE)) == 1 and quality.prose_share("") == 0 and quality.prose_share("a = 1\nb = 2") == 0
    assert quality.prose_share("> " + PROSE[0].upper()) > 0.9 and quality.prose_share("// " + PROSE[0].lower().replace("memory", "memory\n//")) > 0.8
    assert quality.prose_share("```\n" + PROSE[0] + "\n```") == 0


def test_statistics_against_python(spark):
    t = "One two, three.\r\n\r\n- x_y 12!\rlast line here"
    r = quality.statistics(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    words = t.split()
    visible = sum(map(len, words))
    assert (r.chars, r.words, r.lines) == (len(t), len(words), 3)
    assert abs(r.mean_word_length - visible / len(words)) < 1e-9
    assert abs(r.symbol_share - sum(not c.isalnum() and not c.isspace() for c in t) / visible) < 1e-9
    assert abs(r.digit_share - 2 / visible) < 1e-9 and abs(r.punct_line_share - 2 / 3) < 1e-9
    assert abs(r.common_share - sum(w.strip(quality.AROUND).lower() in quality._COMMON for w in words) / len(words)) < 1e-9


def test_rules_hold_out(spark):
    docs = documents(400)
    df = spark.createDataFrame([(i, t) for i, (t, _) in docs], "doc_id long, text string").withColumn("words", F.lit("clash"))
    got = {r.doc_id: r.junk for r in quality.judge(df, sample=200).collect()}
    assert sum(got[i] == j for i, (_, j) in docs) / len(docs) >= 0.97


def test_nulls_blanks_repeats_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " \u00a0\n"), (4, "- a_b\n- c_d\n- e_f"), (4, "- a_b\n- c_d\n- e_f"), (None, PROSE[0]), (5, PROSE[1] * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.words, r.junk) for r in quality.judge(df).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, 0, False), (2, 0, False), (3, 0, False)]
    assert [x[2] for x in got if x[0] == 4] == [True, True] and len(got) == 7
    assert quality.judge(df.limit(0)).count() == 0


def test_rule_induction():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 0] <= 0.3) & (x[:, 1] > 0.5)) | (x[:, 4] > 0.9)
    rules = quality.irep(x, y)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= quality._covers(r, x)
    assert (hit == y).mean() > 0.95
    assert quality.irep(x, np.zeros(600, bool)) == [] and quality.to_case([], True) == "TRUE"
    assert quality.to_case([[(0, True, 0.5), (2, False, 1.0)]]) == "CASE WHEN words <= 0.5D AND symbol_share > 1.0D THEN TRUE ELSE FALSE END"


def test_learned_on_held_out_rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in documents(900)], "doc_id long, text string")
    got = quality.learn(df)
    assert got.held == 180 and got.rules >= 1 and got.precision >= 0.9 and got.recall >= 0.9
    assert quality.learn(df.repartition(3)) == got


def test_labels_know_no_words_of_the_statistics():
    made_up = "Wurrel tha gorlim in to blayder, sno arg heffin koltred em ustra venn."
    assert quality.prose_share(made_up) == 1 and not set(made_up.lower().split()) <= quality._COMMON
    assert quality.prose_share("of the and to in a is it on as was for that with") == 0
    assert quality.prose_share("free index top graph cheap code best tree") == 0
