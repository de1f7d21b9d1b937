"""Quality scores of a generalised additive model with pairwise interactions.

The model adds up look-up tables: one for each feature and one for each chosen pair of features.
They are learned by cyclic boosting: round after round, each feature in turn gets a shallow tree
over its bins, fitted to the gradient of the log loss and shrunk; pairs are then ranked by the
gain of one cut in each of their two features and boosted alike. A document is scored by finding
its bins and adding the tables' entries.

Defined cases: a null or empty text has zero counts and is scored like any other; a null doc_id
is passed through; of a label given twice the highest counts; without labels every score is 0.5;
repeated rows are scored each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keyed_text, labelled_sample, lean, text_slices

SAMPLE, SLICE_CHARS = 20_000, 2_000_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST = 120, 60, 0.15, 4, 20
THRESHOLD = 0.3
#: Classes of characters that are counted.
CLASSES = ("lower", "upper", "digit", "blank", "line", "symbol", "stop", "bang", "other")
FEATURES = ("words", "word_length", "lines", "words_per_line", "distinct_words", "double_lines", "short_words", "upper", "digit", "symbol", "stop", "bang", "other", "longest_word")


@cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, CLASSES.index("other"), np.int8)
    for c in range(0x30000):
        char = chr(c)
        if char.isupper():
            table[c] = CLASSES.index("upper")
        elif char.isalpha():
            table[c] = CLASSES.index("lower")
        elif char.isdigit():
            table[c] = CLASSES.index("digit")
        elif char.isspace():
            table[c] = CLASSES.index("blank")
    for chars, name in (("\n", "line"), ("#*$%&|<>", "symbol"), (".,;:", "stop"), ("!?", "bang")):
        for char in chars:
            table[ord(char)] = CLASSES.index(name)
    return table


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    n, k = len(texts), len(CLASSES)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(n), [len(t) for t in texts])
    counts = np.bincount(owner * k + _classes()[points], minlength=n * k).reshape(n, k).astype(float)
    of = {name: counts[:, i] for i, name in enumerate(CLASSES)}
    rest = np.zeros((n, 6))
    for i, text in enumerate(texts):
        words = text.split()
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        sizes = list(map(len, words))
        rest[i] = len(words), len(set(words)), len(lines), len(lines) - len(set(lines)), sum(map((4).__gt__, sizes)), max(sizes, default=0)
    words, distinct, lines, double, short, longest = rest.T
    chars = np.maximum(counts.sum(1) - of["blank"] - of["line"], 1)
    some, rows = np.maximum(words, 1), np.maximum(lines, 1)
    return np.stack([words, chars / some, lines, words / rows, distinct / some, double / rows, short / some, of["upper"] / chars, of["digit"] / chars, of["symbol"] / some, of["stop"] / some, of["bang"] / some, of["other"] / chars, longest], 1)


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(gradient: np.ndarray, weight: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The steps of a shallow tree over the bins: cuts with the most gain, one after another."""
    leaves = [(0, len(gradient))]
    g, h, c = (np.concatenate([[0.0], np.cumsum(x)]) for x in (gradient, weight, count))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for leaf in leaves:
            a, b = leaf
            at = np.arange(a + 1, b)
            at = at[(c[at] - c[a] >= LEAST) & (c[b] - c[at] >= LEAST)]
            if len(at):
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), leaf, int(at[gain.argmax()]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


class Model:
    """Tables of single features and of pairs, with their cuts."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [_cuts(x[:, k], BINS) for k in range(x.shape[1])]
        self.coarse = [_cuts(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        fine = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)]
        rough = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.coarse)]
        total = np.full(len(y), self.base)
        sums = lambda bins, p, size: [np.bincount(bins, v, size) for v in (y - p, p * (1 - p), np.ones(len(y)))]
        for _ in range(ROUNDS):
            for k, bins in enumerate(fine):
                step = RATE * _tree(*sums(bins, self._share(total), len(self.tables[k])))
                self.tables[k] += step
                total += step[bins]
        self._pick(rough, y - self._share(total))
        for _ in range(PAIR_ROUNDS):
            for k, (i, j) in enumerate(self.pairs):
                wide = len(self.coarse[j]) + 1
                bins = rough[i] * wide + rough[j]
                g, h, _ = (s.reshape(-1, wide) for s in sums(bins, self._share(total), self.pair_tables[k].size))
                step = RATE * self._corner(g, h)
                self.pair_tables[k] += step
                total += step.ravel()[bins]

    @staticmethod
    def _share(total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    @staticmethod
    def _corner(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One cut in each of two features: the four corners with the most gain."""
        gs, hs = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
        best, out = 0.0, np.zeros_like(g)
        for a in range(1, g.shape[0]):
            for b in range(1, g.shape[1]):
                quarter = lambda s: (s[a, b], s[a, -1] - s[a, b], s[-1, b] - s[a, b], s[-1, -1] - s[a, -1] - s[-1, b] + s[a, b])  # noqa: B023, E731
                g4, h4 = quarter(gs), quarter(hs)
                if (gain := sum(u * u / (v + 1) for u, v in zip(g4, h4, strict=True))) > best:
                    best = gain
                    steps = [u / (v + 1) for u, v in zip(g4, h4, strict=True)]
                    out = np.zeros_like(g)
                    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = steps
        return out

    def _pick(self, rough: list[np.ndarray], rest: np.ndarray) -> None:
        gains = []
        for i, j in combinations(range(len(rough)), 2):
            wide = len(self.coarse[j]) + 1
            size = (len(self.coarse[i]) + 1) * wide
            bins = rough[i] * wide + rough[j]
            g = np.bincount(bins, rest, size).reshape(-1, wide)
            n = np.bincount(bins, minlength=size).reshape(-1, wide)
            alone = (g.sum(1) ** 2 / (n.sum(1) + 1)).sum() + (g.sum(0) ** 2 / (n.sum(0) + 1)).sum()
            gains.append((float((g**2 / (n + 1)).sum() - alone), i, j))
        for _, i, j in sorted(gains, key=lambda x: (-x[0], x[1:]))[:PAIRS]:
            self.pairs.append((i, j))
            self.pair_tables.append(np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return self._share(total)


def _measured(docs: DataFrame) -> DataFrame:
    """The id and the features of each text."""

    def run(batches):
        for ids, texts in text_slices(batches, SLICE_CHARS):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(x[:, k]) for k in range(x.shape[1])]], ["doc_id", *FEATURES])

    return docs.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model | None:
    sample = labelled_sample(docs, labels, "quality", bound, 5, 0)
    # The label goes along in the place of the id, which is no input of the features.
    labelled = sample.select(F.col("y").cast("long").alias("doc_id"), "text")
    rows = sorted(tuple(r) for r in _measured(labelled).collect())  # a bounded sample
    return Model(np.array([r[1:] for r in rows]), np.array([r[0] for r in rows], float)) if rows else None


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        model = held.value
        for ids, texts in text_slices(batches, SLICE_CHARS):
            p = model.score(features(texts)) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p)], ["doc_id", "score"])

    found = keyed_text(docs).mapInArrow(lean(run), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
