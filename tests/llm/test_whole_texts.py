"""Operators of texts do the whole of their job: fixtures that a cut would change."""

import math
import random
import re
from collections import Counter

import brute

from sparkloom.llm import pii, toxicity


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def entities(text):
    """Of e-mails alone, which is what the fixture names."""
    return {m.group().lower() for m in brute.EMAIL.finditer(text)}


def terms_by_brute_force(rows, support=3, threshold=0.8):
    """doc_id -> places of terms, of whole documents counted pair by pair."""
    words = {k: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)} for k, t in rows}
    named = {k: entities(t) for k, t in rows}
    c_t, c_e = (Counter(x for xs in held.values() for x in xs) for held in (words, named))
    c_te = Counter((t, e) for k in words for t in words[k] for e in named[k])
    n = len(rows)
    flagged = {t for (t, e), c in c_te.items() if c >= support and c_e[e] < n and math.log(n * c / (c_t[t] * c_e[e])) / math.log(n / c_e[e]) >= threshold}
    out = {}
    for k, t in rows:
        taken = [m.span() for m in brute.EMAIL.finditer(t)]
        out[k] = [m.span() for m in re.finditer(r"[^\W\d_]{4,}", t) if m.group().lower() in flagged and not any(a < m.end() and m.start() < b for a, b in taken)]
    return out


def test_terms_are_found_far_from_an_entity_and_in_every_document(spark):
    rnd = random.Random(9)
    filler = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "of", "a"]) for _ in range(n))
    rows = [(k, f"Zanzibar {filler(60)}\n{filler(5)} chief@corp.example {filler(20)} zanzibar") for k in range(8)]
    rows += [(8, f"{filler(9)} ZANZIBAR, {filler(9)}"), *((k, filler(40)) for k in range(9, 70))]
    rows += [(k, f"Écrin {filler(30)} x@y.zz {filler(300)} écrin{k % 2}") for k in range(70, 74)]
    want = terms_by_brute_force(rows)
    found = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term")] for r in pii.find(frame(spark, rows)).collect()}
    assert found == want
    assert len(want[0]) == 2 and len(want[8]) == 1 and not want[20] and len(want[70]) == 2
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert not any(re.search("zanzibar|écrin", t.lower()) for t in clean.values()) and clean[20] == rows[20][1]


def test_misspelled_words_match_under_a_stem_and_with_four_letters(spark):
    rnd = random.Random(10)
    short = lambda: "".join(rnd.choice("abcdefghij") for _ in range(3))
    rows = [(k, f"{short()} {short()} {bad} {short()} {short()}", 1) for k, bad in enumerate(["idiot", "idiots", "idiotic", "scum"] * 15)]
    rows += [(100 + k, " ".join(short() for _ in range(6)), 0) for k in range(60)]
    words, stems, clean = toxicity.lexicon(frame(spark, rows, "doc_id long, text string, y int"))
    assert stems == ["idio"] and words == ["idiot", "idiotic", "idiots", "scum"]
    matcher = toxicity.Matcher(words, stems, clean)
    kinds = [row[1:4] for row in matcher.counts(["iidiot", "idxot", "idiocy", "scuum", "scxm", "idiot"])]
    assert kinds == [[0, 0, 1], [0, 0, 1], [0, 1, 0], [0, 0, 1], [0, 0, 1], [1, 0, 0]]
