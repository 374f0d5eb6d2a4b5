"""Per-document text statistics and the documents that are not prose (problem 10).

The statistics are built-in expressions over whole texts. An ordered rule list over them is
induced on labelled documents by incremental reduced-error pruning: a rule grows by
the best threshold test at a time on one part of the data and is pruned on the
other; covered documents are removed and the next rule is induced, until a rule errs too
often. The labels come from a parser of sentences that looks at their build alone: it knows no
words, and none of the statistics. It is too slow for the whole corpus and runs on a
bounded sample, a fifth of which is held out to measure the rules. The learned thresholds
become one SQL CASE expression that is applied natively.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that are labelled and learned from, the ones with the smallest hashes.
SAMPLE = 6_000
#: Tasks that label them, and the fewest from which rules are learned.
PARTS, LEAST = 16, 50

# Common function words of English, German, French and Spanish.
COMMON = {
    "en": "a about after again all also an and any are as at back be because been before being but by can could did do does for from had has have he her here him his how i if in into is it its just like may me more most my no not now of on once one only or other our out over she should since so some such than that the their them then there these they this those to too two up us was we were what when where which while who why will with would you your",
    "de": "aber als also am an auch auf aus bei beim bis da damit das dass dem den der des die dies diese diesen dieser doch durch ein eine einem einen einer eines er es etwa für ganz hat hier ich ihr ihre im immer in ist ja kann kein keine mal man mehr meine mir mit muss musste nach nachdem nicht noch nur ob oder ohne schon sehr sein sich sie sind so soll über um und uns unter vom von vor war warum was weil wenn wer werden wie wir wird wo wurde wurden zu zum zur zwei",
    "fr": "a afin ainsi alors après au aucun aussi autre aux avant avec bien car ce cela ces cet cette ceux chaque ci comme comment dans de depuis des deux doit donc dont du elle elles en encore entre est et été être fait il ils je la le les leur leurs lui mais mon même n ne ni nos notre nous on ont ou où par pas peu plus pour pourquoi qu quand que quel qui sa sans se ses si soit son sont sous sur ta tout toute toutes très trop un une vers vous y d l s j c",
    "es": "a al algo ante antes aquí así aún aunque bien cada casi como con cual cuando de del desde donde dos el ella ellos en entre era es esa ese eso esta está este esto estos fue ha han hasta hay la las le les lo los más me mi mientras muy nada ni no nos o otra otro para pero poco por porque pues que qué quien se según ser si sí siempre sin sino sobre son su sus también tan tanto te tiene todo todos tras tu un una unos uno y ya yo",
}
_COMMON = frozenset(w for ws in COMMON.values() for w in ws.split())

_BULLET = re.compile(r"^(?:[-*+•·–]|\d{1,3}[.)]|[a-z][.)])\s+")
_MARKS = re.compile(r"^(?:(?:>+|//+!?|#+|\*+|--+|;+|%+|\|)\s?)+")
_SPEAKER = re.compile(r"^(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s+)?(?:<?@?[\w.\-]{1,24}>?:|<[\w.\-]{1,24}>)\s+")
_TOKEN = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+")
#: A word, perhaps hyphenated or elided, with quotes, brackets and punctuation around it.
_PLAIN = re.compile(r"[\"'“”«»‹›„(\[`]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[\"'“”«»‹›)\]`]*[.,;:!?…]*[\"'”»)\]]*")


def _is_sentence(s: str, closed: bool) -> bool:
    """Whether a run of words is built like a sentence: mostly plain words, short ones among them but not alone, and
    an end or at least a pause."""
    tokens = s.split()
    plain = [t for t in tokens if _PLAIN.fullmatch(t)]
    w = [x for t in plain for x in _TOKEN.findall(t)]
    if len(w) < 3 or 10 * len(plain) < 7 * len(tokens):
        return False
    letters, short = sum(map(len, w)), sum(len(x) <= 3 for x in w)
    if len(w) >= 8 and letters < 3.4 * len(w):
        return False  # nothing but little words strung together
    return 10 * short >= len(w) and (closed or (len(w) >= 6 and "," in s))


def _visible(s: str) -> int:
    return sum(map(len, s.split()))


def prose_share(text: str) -> float:
    """The share of a text's visible characters that belong to sentences of prose, by parsing its blocks into sentences."""
    total = _visible(text)
    if not total:
        return 0.0
    blocks: list[str] = []
    fresh, fenced = True, False
    for raw in re.split(r"\r\n|\r|\n", text):
        line = raw.strip()
        if line.startswith(("```", "~~~")):
            fenced, fresh = not fenced, True
            continue
        if fenced:
            continue
        bare = _MARKS.sub("", line).strip()
        if not bare:
            fresh = True
            continue
        item, speaker = _BULLET.match(line), _SPEAKER.match(bare)
        if item:
            bare = line[item.end():]
        elif speaker:
            bare = bare[speaker.end():]
        if fresh or item or speaker or "\t" in bare or "   " in bare:
            blocks.append(bare)
        else:
            blocks[-1] += " " + bare
        fresh = False
    good = 0
    for b in blocks:
        parts = _SENTENCE.split(b)
        for s in parts:
            closed = re.search(r"[.!?…:;][\"'”»)\]]*\s*$", s) is not None
            if _is_sentence(s, closed):
                good += _visible(s)
    return good / total


# White space as in Unicode's White_Space; signs around a word; signs that end a line and what may follow them.
BLANK = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
AROUND, ENDS, AFTER_END = "\"(),.;:!?…«»„“”‹›[]", ".!?:;…", "\"'”»)]"

FEATURES = ["words", "mean_word_length", "symbol_share", "digit_share", "punct_line_share", "common_share", "mean_line_words"]


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the statistics of each row's text.

    chars: characters; words: runs of non-blanks; lines: lines that aren't blank; mean_word_length: characters a word;
    symbol_share, digit_share: of the visible characters those that are neither letters nor digits, and digits;
    punct_line_share: of the lines those ending in punctuation; common_share: common words (also parted by
    apostrophes, without the signs around them) a word; mean_line_words: words a line. Null, empty and blank texts have 0 words and
    lines, and null shares.
    """
    t = F.col("_t")
    parted = F.split(F.lower(t), r"(?U)[\s'’]+")
    lines = F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    ended = F.size(F.filter("_l", lambda x: F.right(F.rtrim(x, F.lit(BLANK + AFTER_END)), F.lit(1)).isin(*ENDS)))
    share = lambda a, b: F.when(b > 0, a / b)
    n, w, size = F.col("_n"), F.col("_w"), F.size("_l")
    return (
        df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"), F.col(text).alias("_text"))
        .withColumn("_l", lines)
        .withColumn("_n", F.length(F.regexp_replace(t, r"(?U)\s+", "")))
        .withColumn("_w", F.regexp_count(t, F.lit(r"(?U)\S+")))
        .select(
            key, "_text", F.length("_text").alias("chars"), w.alias("words"), size.alias("lines"),
            share(n, w).alias("mean_word_length"),
            share(F.length(F.regexp_replace(t, r"(?U)[\p{L}\p{N}\s]+", "")), n).alias("symbol_share"),
            share(F.length(F.regexp_replace(t, r"[^0-9]+", "")), n).alias("digit_share"),
            share(ended, size).alias("punct_line_share"),
            share(F.size(F.filter(parted, lambda x: F.btrim(x, F.lit(AROUND)).isin(*_COMMON))), w).alias("common_share"),
            share(w, size).alias("mean_line_words"),
        )
    )


Rule = list[tuple[int, bool, float]]  # tests: the feature's number, whether it must be at most the threshold, the threshold


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for f, below, at in rule:
        hit &= (x[:, f] <= at) if below else (x[:, f] > at)
    return hit


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    rule: Rule = []
    while len(y) and not y.all() and len(rule) < 8:
        p0 = max(y.mean(), 1e-9)
        best, test = 1e-9, None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, yes = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            all_ = cut + 1
            for below, p, n in ((True, yes[cut], all_), (False, yes[-1] - yes[cut], len(y) - all_)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / n) - np.log2(p0)), 0)  # FOIL's
                k = int(gain.argmax())
                if gain[k] > best:
                    best, test = gain[k], (f, below, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if test is None:
            break
        rule.append(test)
        keep = _covers([test], x)
        x, y = x[keep], y[keep]
    return rule


def irep(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """An ordered rule list for the true class by incremental reduced-error pruning."""
    rng, rules = np.random.default_rng(seed), []
    while y.any() and len(rules) < 30:
        mix = rng.permutation(len(y))
        cut = max(1, len(y) * 2 // 3)
        grow, prune = mix[:cut], mix[cut:]
        if not y[grow].any():
            break
        rule = _grow(x[grow], y[grow])
        worth = []
        for k in range(1, len(rule) + 1):
            hit = y[prune][_covers(rule[:k], x[prune])]
            worth.append((2 * hit.sum() - len(hit)) / max(1, len(hit)))
        if not rule or max(worth) <= 0:
            break
        rule = rule[: int(np.argmax(worth)) + 1]
        rules.append(rule)
        left = ~_covers(rule, x)
        x, y = x[left], y[left]
    return rules


def to_case(rules: list[Rule], otherwise: bool = False) -> str:
    """The rule list as one SQL CASE expression over FEATURES; null features satisfy no test."""
    if not rules:
        return str(otherwise).upper()
    tests = [" AND ".join(f"{FEATURES[f]} {'<=' if below else '>'} {at!r}D" for f, below, at in r) for r in rules]
    return "CASE " + " ".join(f"WHEN {t} THEN TRUE" for t in tests) + " ELSE FALSE END"


def labelled(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Features and label (not prose) of at most ``sample`` documents that aren't blank, those of the smallest hashes."""
    n = df.count()
    h = F.xxhash64(key)
    share = min(1.0, 1.2 * sample / max(1, n))
    some = df.filter(h <= F.lit(int(-(2**63) + share * (2**64 - 2)) if share < 1 else 2**63 - 1)).filter(F.regexp_like(text, F.lit(r"(?U)\S")))
    some = some.select(key, text).orderBy(h, key).limit(sample).repartition(PARTS, h)

    def run(batches):
        for b in batches:
            y = [prose_share(t) < 0.5 for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(f) for f in FEATURES], pa.array(y, pa.bool_())], names=[*FEATURES, "junk"])

    stats = statistics(some, key, text).select("_text", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])
    return stats.mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", junk boolean")


@dataclass(frozen=True)
class Learned:
    """The SQL expression for texts that aren't prose, its number of rules and features, and on ``held`` rows that were held out its
    precision and recall (of no such rows 1)."""

    case: str
    rules: int
    features: int
    held: int
    precision: float
    recall: float


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Learned:
    """What a bounded sample of df teaches; fewer than LEAST documents teach nothing, and fewer than a fifth of common words decides."""
    rows = labelled(df, key, text, sample).toArrow()
    if rows.num_rows < LEAST:
        return Learned("common_share < 0.2D", 0, 1, 0, 1.0, 1.0)
    x = np.column_stack([rows.column(f).to_numpy() for f in FEATURES])
    y = rows.column("junk").to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((*x.T, y))  # the same rows give the same rules, however they come
    mix = order[np.random.default_rng(5).permutation(len(order))]
    held, seen = mix[: len(mix) // 5], mix[len(mix) // 5 :]
    rules = irep(x[seen], y[seen])
    says = np.zeros(len(held), dtype=bool) if rules else np.full(len(held), y[seen].mean() > 0.5)
    for r in rules:
        says |= _covers(r, x[held])
    true, both = int(y[held].sum()), int((says & y[held]).sum())
    return Learned(
        to_case(rules, bool(y[seen].mean() > 0.5)), len(rules), len({f for r in rules for f, _, _ in r}), len(held),
        both / max(1, int(says.sum())) if says.any() else 1.0, both / true if true else 1.0,
    )


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The statistics of each row and ``junk``: whether its text is not prose; false for null, empty and blank texts."""
    case = learn(df, key, text, sample).case
    return statistics(df, key, text).withColumn("junk", F.expr(f"words > 0 AND {case}")).drop("_text")
