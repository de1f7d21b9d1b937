"""Toxicity scores from a learned lexicon, matched by Levenshtein automata.

Lexicon entries, words and stems, are what a bounded sample of labelled documents has in toxic
documents almost alone. Words under a stem stay, since only words are matched misspelled. The
entries form a trie; its product with the Levenshtein automaton of one edit is walked state by
state and kept as a table, so a word is matched, misspelled or not, in one look-up per
character, and most words leave the automaton after a few. Each match is seen in its context
window: between quotation marks close by it counts as quotation, else as abuse. A logistic
model of these counts, fitted on the sample, gives the score.

Defined cases: a null or empty text has no match and gets the score of a text without one; a
null doc_id is passed through; of a label given twice the highest counts; without labels every
score is 0; repeated rows are scored each; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keyed_text, labelled_sample, lean, text_slices

SAMPLE, SLICE_CHARS = 20_000, 2_000_000
#: A lexicon entry is in so many toxic documents at least, and so much of its documents are toxic.
SUPPORT, PRECISION = 6, 0.8
#: Lengths of stems; letters of a word whose misspellings are looked for.
STEMS, FUZZY_LETTERS = range(4, 8), 4
CONTEXT, THRESHOLD = 12, 0.3
KEPT_WORDS = 500_000
MARKS = "\"“”„«»"
TOKEN = re.compile(rf"\w+|[{MARKS}]")


class Automaton:
    """The trie of a lexicon times the Levenshtein automaton of one edit, built as it is walked."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        for entries, at in ((words, self.word_at), (stems, self.stem_at)):
            for entry in entries:
                node = 0
                for c in entry:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                    node = self.children[node][c]
                at[node] = entry
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, places) -> int:
        """The number of the state with these (node, edits), -1 if there are none."""
        places = set(places)
        places |= {(child, 1) for node, edits in places if edits == 0 for child in self.children[node].values()}  # a letter left out
        least = frozenset((n, e) for n, e in places if e == 0 or (n, 0) not in places)
        if not least:
            return -1
        if least not in self.ids:
            self.ids[least] = len(self.states)
            self.states.append(least)
            self.moves.append({})
        return self.ids[least]

    def _move(self, state: int, c: str) -> int:
        after = set()
        for node, edits in self.states[state]:
            if (child := self.children[node].get(c)) is not None:
                after.add((child, edits))
            if edits == 0:
                after.add((node, 1))  # a letter too many
                after.update((child, 1) for child in self.children[node].values())  # another letter
        to = self.moves[state][c] = self._state(after)
        return to

    def match(self, word: str) -> tuple[str, str] | None:
        """(kind, entry): exact before stem before fuzzy."""
        state, moves, stem = self.start, self.moves, None
        for c in word:
            to = moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return ("stem", stem) if stem else None
            state = to
            if stem is None:
                stem = next((self.stem_at[n] for n, e in self.states[state] if e == 0 and n in self.stem_at), None)
        ends = [(e, self.word_at[n]) for n, e in self.states[state] if n in self.word_at]
        if (best := min(ends, default=None)) and best[0] == 0:
            return "exact", best[1]
        if stem:
            return "stem", stem
        return ("fuzzy", best[1]) if best and len(best[1]) >= FUZZY_LETTERS else None


class Matcher:
    """The matches in texts, with their context."""

    def __init__(self, words: list[str], stems: list[str], clean: list[str]):
        self.automaton, self.clean = Automaton(words, stems), frozenset(clean)
        self.known: set[str] = set()
        self.hits: dict[str, tuple[str, str]] = {}

    def counts(self, texts: list[str]) -> list[list[float]]:
        split = [TOKEN.findall(t.lower()) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
            self.hits.clear()
        new = set().union(*split).difference(self.known)
        self.known |= new
        for w in new:
            if (m := self.automaton.match(w)) and not (m[0] == "fuzzy" and w in self.clean):
                self.hits[w] = m
        hit, out = self.hits, []
        for tokens in split:
            found = [k for k, w in enumerate(tokens) if w in hit]
            row = [float(len(tokens)), 0.0, 0.0, 0.0, 0.0, 0.0]
            if found:
                quoted = self._quoted(tokens, found)
                for k, q in zip(found, quoted, strict=True):
                    row[4 if q else {"exact": 1, "stem": 2, "fuzzy": 3}[hit[tokens[k]][0]]] += 1
                row[5] = float(len({hit[tokens[k]][1] for k in found}))
            out.append(row)
        return out

    @staticmethod
    def _quoted(tokens: list[str], found: list[int]) -> list[bool]:
        """Whether each place lies between an opening and a closing mark, both in its window."""
        marks = [k for k, w in enumerate(tokens) if w in MARKS]
        before = np.searchsorted(marks, found)
        out = []
        for k, n in zip(found, before.tolist(), strict=True):
            out.append(n % 2 == 1 and n < len(marks) and k - marks[n - 1] <= CONTEXT and marks[n] - k <= CONTEXT)
        return out


def _terms(text: str) -> set[str]:
    """Words as they are, stems with a mark."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) >= 4}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _scattered(sample: DataFrame, terms: set[str]) -> set[str]:
    """The terms that toxic documents have between many different neighbours.

    What copies of one document share stands between the same neighbours in each of them.
    """
    held = sample.sparkSession.sparkContext.broadcast(terms)

    def places(batches):
        wanted, seen = held.value, set()
        for _, texts in text_slices(batches, SLICE_CHARS):
            for t in texts:
                tokens = ["", *TOKEN.findall(t.lower()), ""]
                for k in range(1, len(tokens) - 1):
                    w = tokens[k]
                    for term in {w, *(w[:n] + "*" for n in STEMS)} & wanted:
                        seen.add((term, f"{tokens[k - 1]} {tokens[k + 1]}"))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.string())], ["term", "place"])

    found = sample.where("y = 1").select("doc_id", "text").mapInArrow(lean(places), "term string, place string")
    return {r["term"] for r in found.groupBy("term").agg(F.countDistinct("place").alias("n")).where(F.col("n") >= 2 * SUPPORT).collect()}


def lexicon(sample: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """(words, stems, words one edit from an entry that clean documents use)."""

    def count(batches, wanted=None):
        total: Counter = Counter()
        for _, texts in text_slices(batches, SLICE_CHARS):
            for t in texts:
                terms = _terms(t)
                total.update(terms if wanted is None else terms & wanted.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    def counts(rows, wanted=None):
        found = rows.select("doc_id", "text").mapInArrow(lean(lambda b: count(b, wanted)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        return found

    toxic = {r["term"]: r["n"] for r in counts(sample.where("y = 1")).where(F.col("n") >= SUPPORT).collect()}  # of a bounded sample
    wanted = sample.sparkSession.sparkContext.broadcast(set(toxic))
    other = {r["term"]: r["n"] for r in counts(sample.where("y = 0"), wanted).collect()}
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    # Toxic documents are scaled to be as many as the others.
    scale = sizes.get(0, 1) / max(sizes.get(1, 0), 1)
    good = {t for t, n in toxic.items() if n * scale >= PRECISION * (n * scale + other.get(t, 0) + 1) and n >= 8 * other.get(t, 0)}
    good &= _scattered(sample, good)
    words = sorted(t for t in good if not t.endswith("*"))
    # A stem must hold more documents than any one word of it, else the word says it all.
    most: dict[str, int] = {}
    for w in (t for t in toxic if not t.endswith("*")):
        for n in STEMS:
            if len(w) > n:
                most[w[:n] + "*"] = max(most.get(w[:n] + "*", 0), toxic[w])
    stems: list[str] = []
    for t in sorted((t for t in good if t.endswith("*") and toxic[t] > 1.5 * most.get(t, 0)), key=lambda t: (len(t), t)):
        if not any(t[:-1].startswith(s) for s in stems):
            stems.append(t[:-1])
    held = sample.sparkSession.sparkContext.broadcast((words, stems))

    def near(batches):
        automaton, seen = Automaton(*held.value), set()
        known: set[str] = set()
        for _, texts in text_slices(batches, SLICE_CHARS):
            new = set().union(*(TOKEN.findall(t.lower()) for t in texts)) - known
            known |= new
            seen.update(w for w in new if (m := automaton.match(w)) and m[0] == "fuzzy")
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["word"])

    clean = [r["word"] for r in sample.where("y = 0").select("doc_id", "text").mapInArrow(lean(near), "word string").distinct().collect()]
    return words, stems, sorted(clean)


def _features(row: np.ndarray) -> np.ndarray:
    """Of counts (words, exact, stem, fuzzy, quoted, kinds)."""
    words = np.maximum(row[:, :1], 1)
    hits = row[:, 1:4]
    return np.hstack([np.ones_like(words), np.log1p(hits), np.minimum(hits, 1), np.log1p(row[:, 4:]), np.log1p(200 * hits.sum(1, keepdims=True) / words)])


def fit(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic model, by Newton's method."""
    x = _features(counts)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sample = labelled_sample(docs, labels, "toxic", SAMPLE, 4, 2)
    entries = lexicon(sample)
    held = docs.sparkSession.sparkContext.broadcast(entries)

    def measured(batches):
        matcher = Matcher(*held.value)
        for ids, texts in text_slices(batches, SLICE_CHARS):
            rows = np.array(matcher.counts(texts)).reshape(len(texts), 6)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(rows[:, k]) for k in range(6)]], ["doc_id", "words", "exact", "stem", "fuzzy", "quoted", "kinds"])

    measure = lambda rows: rows.mapInArrow(lean(measured), "doc_id long, words double, exact double, stem double, fuzzy double, quoted double, kinds double")
    # The label goes along in the place of the id, which is no input of the counts.
    labelled = sample.select(F.col("y").cast("long").alias("doc_id"), "text")
    rows = sorted(tuple(r) for r in measure(labelled).collect())  # a bounded sample
    weights = fit(np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])) if rows else None

    def run(batches):
        for batch in measured(batches):
            counts = np.stack([c.to_numpy() for c in batch.columns[1:]], 1)
            p = 1 / (1 + np.exp(-np.clip(_features(counts) @ weights, -30, 30))) if weights is not None else np.zeros(len(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    found = keyed_text(docs).mapInArrow(lean(run), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
