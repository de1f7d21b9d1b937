"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (one to three letters of lower-cased
text, runs of other characters counting as one blank). A document's own n-grams, ranked alike,
are compared with each profile by out-of-place distance: the sum of rank differences, with the
profile's length for an n-gram it lacks. N-grams in no profile are as far from each, so only
those in some profile are ranked. The score is one minus the distance over its maximum.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text
where nothing could be learned; a text none of whose n-grams is known gets the language that
sorts first and score 0; ties go to the language that sorts first; null languages and held-out
rows are not learned from; repeated rows are judged each; an empty table gives an empty one;
other columns are ignored by ``identify`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, keyed_text, lean, short_batches, text_slices

#: N-grams of a profile; labelled documents that profiles are learned from, at most about.
LENGTH, SAMPLE = 400, 10_000
SLICE_CHARS = 500_000
#: Counts of grams by text that are held at a time.
CELLS = 2_000_000
#: A document is rejected below this score or where it is undetermined.
LEAST_SCORE = 0.2
MAX_ORDER = 3


@cache
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with every run of other characters one blank (0), and the text each is of."""
    low = [t.lower() + " " for t in texts]
    points = np.frombuffer((" " + "".join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points] == 1, points, 0)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    keep = (points[1:] != 0) | (points[:-1] != 0)
    return points[1:][keep], owner[keep]


def _grams(codes: np.ndarray, owner: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, owner) for each order; grams of different orders never share a number."""
    codes = codes.astype(np.int64)
    gram = codes + 1
    yield gram[codes > 0], owner[codes > 0]
    for k in range(1, MAX_ORDER):
        gram = (gram[:-1] << width) + codes[k:] + 1
        own = owner[k:]
        inside = (own == owner[: len(own)]) & ~((codes[k:] == 0) & (codes[k - 1 : -1] == 0))
        yield gram[inside], own[inside]


def _spell(gram: int, width: int) -> str:
    out = []
    while gram > 0:
        code = (gram - 1) & ((1 << width) - 1)
        out.append(chr(code) if code else " ")
        gram = (gram - 1 - code) >> width
    return "".join(reversed(out))


def learn(docs: DataFrame, bound: int = SAMPLE, length: int = LENGTH) -> dict[str, dict[str, int]]:
    """The rank of each n-gram of each language, from rows that are not held out."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    share = min(1.0, bound / max(known.select("doc_id").count(), 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)).select("lang", "text")

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for langs, texts in text_slices(batches, SLICE_CHARS):
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs])
            points, owner = _points(texts)
            for gram, own in _grams(points, owner, 21):
                lang = of[own]
                for k, name in enumerate(names):
                    grams, times = np.unique(gram[lang == k], return_counts=True)
                    into = total.setdefault(name, {})
                    for g, n in zip(grams.tolist(), times.tolist(), strict=True):
                        into[g] = into.get(g, 0) + n
        for name, counts in total.items():
            grams = [_spell(g, 21) for g in counts]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams, pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])

    counted = sample.mapInArrow(lean(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    profiles: dict[str, dict[str, int]] = {}
    for row in top.collect():  # languages times length rows
        profiles.setdefault(row["lang"], {})[row["gram"]] = row["rank"] - 1
    return dict(sorted(profiles.items()))


class Profiles:
    """Scores texts against rank-order profiles, many at a time."""

    def __init__(self, profiles: dict[str, dict[str, int]], length: int = LENGTH):
        self.langs, self.length = list(profiles), length
        self.grams = sorted({g for p in profiles.values() for g in p}, key=lambda g: (min(p.get(g, length) for p in profiles.values()), g))
        self.ranks = np.array([[p.get(g, length * 4) for g in self.grams] for p in profiles.values()], np.int32).reshape(len(profiles), len(self.grams))
        letters = sorted({c for g in self.grams for c in g if c != " "})
        self.width = max(2, (len(letters) + 2).bit_length() + 1)
        self.classes = np.where(_letters() == 1, len(letters) + 1, 0).astype(np.uint16)
        for k, c in enumerate(letters):
            self.classes[ord(c)] = k + 1
        self.table = np.full((MAX_ORDER + 1) << (self.width * MAX_ORDER), -1, np.int16) if self.width * MAX_ORDER <= 24 else {}
        index = {c: k + 1 for k, c in enumerate(letters)} | {" ": 0}
        for k, g in enumerate(self.grams):
            number = 0
            for c in g:
                number = (number << self.width) + index[c] + 1
            self.table[number] = k

    def _ids(self, grams: np.ndarray) -> np.ndarray:
        if isinstance(self.table, dict):  # very many letters
            values, back = np.unique(grams, return_inverse=True)
            return np.array([self.table.get(v, -1) for v in values.tolist()], np.int64)[back]
        return self.table[grams]

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language and the score of each text, in blocks of so many texts that counts of all grams fit ``CELLS``."""
        step = max(1, CELLS // max(len(self.grams), 1))
        blocks = [self._score(texts[k : k + step]) for k in range(0, len(texts), step)]
        return [x for langs, _ in blocks for x in langs], [x for _, scores in blocks for x in scores]

    def _score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        n, size = len(texts), max(len(self.grams), 1)
        points, owner = _points(texts)
        lettered = np.bincount(owner[points > 0], minlength=n) > 0
        if not self.langs:
            return ["und"] * n, [0.0] * n
        counts = np.zeros(n * size, np.int64)
        for gram, own in _grams(self.classes[points], owner, self.width):
            ids = self._ids(gram)
            hit = ids >= 0
            counts += np.bincount(own[hit].astype(np.int64) * size + ids[hit], minlength=n * size)
        counts = counts.reshape(n, size)
        order = np.argsort(-counts, axis=1, kind="stable")[:, : self.length]
        present = np.take_along_axis(counts, order, 1) > 0
        place = np.arange(order.shape[1], dtype=np.int32)
        far = np.stack([(np.minimum(np.abs(r[order] - place), self.length) * present).sum(1) for r in self.ranks])
        best = far.argmin(0)
        most = np.maximum(present.sum(1) * self.length, 1)
        score = np.where(lettered & present.any(1), 1 - far[best, np.arange(n)] / most, 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score.tolist()


def identify(docs: DataFrame, profiles: dict[str, dict[str, int]]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def run(batches):
        judge = Profiles(profiles)
        for ids, texts in text_slices(batches, SLICE_CHARS):
            langs, scores = judge.score(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = keyed_text(docs).mapInArrow(lean(run), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, profiles: dict[str, dict[str, int]], least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is determined well enough, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        judge = Profiles(profiles)
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                langs, scores = judge.score([x or "" for x in part.column(at).to_pylist()])
                yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores, strict=True)]))

    return short_batches(docs).mapInArrow(lean(run), docs.schema)
