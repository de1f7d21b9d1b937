"""Quality rules as learned decision lists, by DataFrame functions only.

``statistics`` computes each text's counts. ``learn`` grows threshold conjunctions on part of a
bounded sample of labelled rows by sequential covering (the condition with the most FOIL gain is
added until the rule is pure enough), prunes them on the rest, and stops when no rule is good
on the rows not yet covered. The list becomes one ordered Spark conditional expression.

Defined cases: a null text has no words and fails the base; a null doc_id is kept; repeated
rows are judged each; of a label given twice the lowest counts; without labels there is no rule
and the base alone decides; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_text

MIN_WORDS = 50
#: Labelled rows that the list is learned from: so many at most, chosen by a hash of doc_id.
SAMPLE = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 24
#: A rule must be right on so much of what it covers, and cover so many rows, grown and pruned.
PURITY, LEAST = 0.9, 8
NUMBERS = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "digit_rate", "words_per_line")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the contract and the numbers that conditions are made of."""
    rows = keyed_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("w"),
        F.length(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^\\p{Lu}]+", "")).alias("_upper"),
        F.length(F.regexp_replace("text", "[^!?]+", "")).alias("_bangs"),
        F.length(F.regexp_replace("text", "[^0-9]+", "")).alias("_digits"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
    )
    rows = rows.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("_n_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    ).drop("w", "_lines")
    # Most texts repeat no window: only the others sort theirs.
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    ranked = F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_s", ranked)
    same = lambda k, x: F.coalesce(F.when(k >= 0, F.get("_s", k)["h"] == x["h"]), F.lit(False))
    at = F.array_sort(F.transform(F.filter("_s", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))
    covered = F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + 3 - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_s", "_h")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / words).alias("symbol_rate"),
        (F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))).alias("dup_line_rate"), (F.col("n_repeat_words") / words).alias("repeat_rate"),
        (F.col("_upper") / chars).alias("upper_rate"), (F.col("_bangs") / words).alias("bang_rate"), (F.col("_digits") / chars).alias("digit_rate"),
        (F.col("n_words") / F.greatest("_n_lines", F.lit(1))).alias("words_per_line"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sample_of(labels: DataFrame, label: str, bound: int = SAMPLE) -> DataFrame:
    """doc_id and y of at most about ``bound`` labelled rows, the same ones every time."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    share = min(1.0, bound / max(known.count(), 1))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def _holds(row, condition) -> bool:
    k, above, cut = condition
    return row[k] >= cut if above else row[k] < cut


def _quality(rows, conditions) -> tuple[int, int]:
    bad = good = 0
    for values, y in rows:
        if all(_holds(values, c) for c in conditions):
            good, bad = good + y, bad + 1 - y
    return bad, good


def _best(rows, cuts):
    """The condition with the most FOIL gain over ``rows``."""
    bad, good = sum(1 - y for _, y in rows), sum(y for _, y in rows)
    best, most = None, 1e-9
    for k, marks in enumerate(cuts):
        bins = [[0, 0] for _ in range(len(marks) + 1)]
        for values, y in rows:
            v, a, b = values[k], 0, len(marks)
            while a < b:
                m = (a + b) // 2
                if v >= marks[m]:
                    a = m + 1
                else:
                    b = m
            bins[a][y] += 1
        below = [0, 0]
        for i, cut in enumerate(marks):
            below = [below[0] + bins[i][0], below[1] + bins[i][1]]
            for above, (b, g) in ((False, below), (True, [bad - below[0], good - below[1]])):
                if b >= LEAST and (gain := b * (log2((b + 1) / (b + g + 2)) - log2((bad + 1) / (bad + good + 2)))) > most:
                    best, most = (k, above, cut), gain
    return best


def learn_list(rows: list[tuple[tuple[float, ...], int]]) -> list[tuple[tuple[int, bool, float], ...]]:
    """Rules that reject, in order; rows are (numbers, label) and label 0 is what they look for."""
    if not rows:
        return []
    cuts = []
    for k in range(len(rows[0][0])):
        values = sorted(v[k] for v, _ in rows)
        cuts.append(sorted({values[len(values) * q // CUTS] for q in range(1, CUTS)} | {values[len(values) * q // 1000] for q in (5, 10, 20, 980, 990, 995)}))
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules = []
    while len(rules) < MAX_RULES:
        left, rule = grow, []
        while len(rule) < MAX_CONDITIONS and any(y for _, y in left) and (c := _best(left, cuts)):
            rule.append(c)
            left = [r for r in left if _holds(r[0], c)]
        if not rule:
            break
        worth = lambda cs: (lambda b, g: (b - g) / max(b + g, 1))(*_quality(prune, cs))
        while len(rule) > 1:
            shorter = max((rule[:k] + rule[k + 1 :] for k in range(len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        b, g = _quality(prune, rule)
        bg, gg = _quality(grow, rule)
        if b + bg < LEAST or b + bg < PURITY * (b + bg + g + gg) or b < PURITY * (b + g):
            break
        rules.append(tuple(rule))
        grow, prune = ([r for r in part if not all(_holds(r[0], c) for c in rule)] for part in (grow, prune))
    return rules


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> list:
    sample = sample_of(labels, label, bound)  # within the bound, so it may be broadcast
    # Rows are filtered here: a filter pushed down would copy the array expressions into it.
    found = stats.join(F.broadcast(sample), "doc_id").select("doc_id", "y", base_failed().alias("failed"), *NUMBERS).collect()
    rows = list({r["doc_id"]: r for r in sorted(found, key=lambda r: r) if not r["failed"]}.values())
    return learn_list([(tuple(float(r[n]) for n in NUMBERS), r["y"]) for r in rows])


def verdict(rules: list) -> Column:
    """True unless a rule rejects: one ordered conditional expression."""
    out = None
    for rule in rules:
        fits = F.lit(True)
        for k, above, cut in rule:
            fits = fits & (F.col(NUMBERS[k]) >= cut if above else F.col(NUMBERS[k]) < cut)
        out = F.when(fits, False) if out is None else out.when(fits, False)
    return out.otherwise(True) if out is not None else F.lit(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of every document, whether it fails the base, and whether it is kept."""
    stats = statistics(docs)
    rules = learn(stats, labels)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.when(base_failed(), False).otherwise(verdict(rules)).alias("kept"))
