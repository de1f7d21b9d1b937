"""Holographic facts: words as phases, facts as bundles of bound parts, and what can be asked of them."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = 2 * math.pi
DIM = 1024
# The atoms of an empty text and of the roles that parts of a fact play, and what is stripped off words.
EMPTY, ROLE_CONTENT, ROLE_ENTITY = "__hrr_empty__", "__hrr_role_content__", "__hrr_role_entity__"
STRIPPED = ".,!?;:\"'()[]{}"


@lru_cache(maxsize=20_000)
def atom(word: str, dim: int = DIM) -> np.ndarray:
    """A word's phases: SHA-256 of the word and a block's number, 16 little-endian numbers of 16 bits a block."""
    blocks = b"".join(hashlib.sha256(f"{word}:{k}".encode()).digest() for k in range(-(-dim // 16)))
    return np.frombuffer(blocks, "<u2")[:dim] * (TURN / 65536)


def bundle(vectors) -> np.ndarray:
    """The circular mean of vectors, which stays near each of them."""
    return np.angle(np.sum([np.exp(1j * v) for v in vectors], axis=0)) % TURN


def text_vector(text: str | None, dim: int = DIM) -> np.ndarray:
    words = [w for x in (text or "").lower().split() if (w := x.strip(STRIPPED))]
    return bundle([atom(w, dim) for w in words]) if words else atom(EMPTY, dim)


def fact_vector(content: str | None, entities, dim: int = DIM) -> np.ndarray:
    parts = [(text_vector(content, dim) + atom(ROLE_CONTENT, dim)) % TURN]
    parts += [(atom(e.lower(), dim) + atom(ROLE_ENTITY, dim)) % TURN for e in (entities if entities is not None else ()) if e is not None]
    return bundle(parts)


def encoded(facts: DataFrame, dim: int = DIM) -> DataFrame:
    """``facts`` (content, entities and others) with their vector; texts without a word are one and the same atom."""

    @F.pandas_udf("array<double>")
    def run(content: pd.Series, entities: pd.Series) -> pd.Series:
        return pd.Series([fact_vector(c, e, dim) for c, e in zip(content, entities, strict=True)])

    return facts.withColumn("vector", run("content", "entities"))


def similarity(a: Column, b: Column) -> Column:
    """The mean cosine of phase differences: 1 for equal vectors, about 0 for unrelated ones."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.cos(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


#: Vectors of a block of all and of a block of those asked; pairs of a task, about.
ROW_BLOCK, QUERY_BLOCK, TASK_PAIRS = 512, 256, 2_000_000


def _phases(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosines and sines of each vector's components, 0 where there is none, and where there are some."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy()
    flat = vectors.flatten().cast(pa.float64())
    at = np.arange(sizes.max(initial=0)) < sizes[:, None]
    value, there = np.zeros(at.shape), np.zeros(at.shape)
    value[at], there[at] = flat.fill_null(0.0).to_numpy(), flat.is_valid().to_numpy(zero_copy_only=False)
    return np.cos(value) * there, np.sin(value) * there, there


def _block_similarities(batches):
    """cos(x - y) is cos x cos y + sin x sin y, so the sums of a block of pairs are two products of matrices."""
    for batch in batches:
        for rows, asked in zip(batch.column(0), batch.column(1), strict=True):
            (b, v), (a, u) = ((x.values.field(0), x.values.field(1)) for x in (rows, asked))
            p, q = _phases(u), _phases(v)
            width = min(p[0].shape[1], q[0].shape[1])
            (cu, su, tu), (cv, sv, tv) = ([m[:, :width] for m in x] for x in (p, q))
            n = tu @ tv.T
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = (cu @ cv.T + su @ sv.T) / n * 1e5
            rounded = (np.trunc(mean + np.copysign(0.5, mean)) / 1e5).ravel()
            # Vectors without a component in common make no pair; where all of them are null the mean is.
            met = np.minimum.outer(*(x.value_lengths().fill_null(0).to_numpy() for x in (u, v))).ravel() > 0
            left, right = np.repeat(np.arange(len(a)), len(b))[met], np.tile(np.arange(len(b)), len(a))[met]
            found = pa.array(rounded[met], mask=(n.ravel() == 0)[met])
            yield pa.RecordBatch.from_arrays([a.take(pa.array(left)), b.take(pa.array(right)), found], ["a", "b", "similarity"])


def similarities(asked: DataFrame, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(a, b, similarity): the mean cosine, to 5 places, of phase differences of every vector asked and every row.

    Blocks of both meet in a plain product, and pairs are made in the tasks. Components that are null or that only one has don't count.
    """

    def blocks(table: DataFrame, parts: int, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64(key, vector), F.lit(parts))
        dealt = table.select(block.alias("block"), F.struct(F.col(key), F.col(vector)).alias("x"))
        return dealt.groupBy("block").agg(F.collect_list("x").alias(name)).select(name)

    n, m = rows.count(), asked.count()
    tasks = int(min(n * m // TASK_PAIRS + 1, 10_000))
    of_rows = blocks(rows, -(-n // ROW_BLOCK) or 1, "r").repartition(tasks)
    pairs = of_rows.crossJoin(blocks(asked, -(-m // QUERY_BLOCK) or 1, "q")).select("r", "q")
    kind = rows.schema[key].dataType.simpleString()
    return pairs.mapInArrow(_block_similarities, f"a {kind}, b {kind}, similarity double")


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(TURN)))


def unbind(memory: Column, key: Column) -> Column:
    return F.zip_with(memory, key, lambda x, y: F.pmod(x - y, F.lit(TURN)))


def _known(vector: np.ndarray) -> Column:
    return F.lit([float(x) for x in vector])


def probe(facts: DataFrame, entity: str, k: int, dim: int = DIM) -> DataFrame:
    """The k facts that hold an entity most strongly: what its role leaves of the fact, beside its atom."""
    left = unbind(F.col("vector"), _known(atom(ROLE_ENTITY, dim)))
    return facts.withColumn("score", similarity(left, _known(atom(entity.lower(), dim)))).orderBy(F.desc("score"), "id").limit(k)


def contradictions(facts: DataFrame, most: float = 0.1, dim: int = DIM) -> DataFrame:
    """id, other and similarity of facts of the stated set (ids divisible by 100) and facts that share an entity and not the content.

    Facts meet by entity, each pair once however many they share; a set of entities asked by few meets all facts that name them.
    """
    content = unbind(F.col("vector"), _known(atom(ROLE_CONTENT, dim)))
    rows = facts.select("id", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("entity"))
    pairs = rows.where("id % 100 = 0").join(rows.withColumnRenamed("id", "other"), "entity").where("id != other").select("id", "other").distinct()
    own = facts.select("id", content.alias("_u"))
    met = pairs.join(own, "id").join(own.select(F.col("id").alias("other"), F.col("_u").alias("_v")), "other")
    return met.select("id", "other", similarity(F.col("_u"), F.col("_v")).alias("similarity")).where(F.col("similarity") < most)


def banks(facts: DataFrame, by: str, dim: int = DIM) -> DataFrame:
    """One vector for each group of facts, its number of facts, and how far signal stands above noise.

    Tasks add up cosines and sines of what they read; sums meet by group and dimension, so no group is gathered.
    """

    def sums(frames):
        for frame in frames:
            if len(frame):
                groups = [(key, np.exp(1j * np.stack(own["vector"].to_list())).sum(axis=0), len(own)) for key, own in frame.groupby(by, dropna=True)]
                yield pd.DataFrame([(g, s.real, s.imag, n) for g, s, n in groups], columns=[by, "re", "im", "n"])

    kind = facts.schema[by].dataType.simpleString()
    parts = facts.select(by, "vector").mapInPandas(sums, f"`{by}` {kind}, re array<double>, im array<double>, n long")
    each = parts.select(by, "n", F.posexplode(F.arrays_zip("re", "im")).alias("at", "x")).groupBy(by, "at").agg(F.sum("x.re").alias("re"), F.sum("x.im").alias("im"), F.sum("n").alias("n"))
    phase = F.pmod(F.atan2("im", "re"), F.lit(TURN))
    made = each.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("at", phase.alias("p")))).alias("v"), F.max("n").alias("n"))
    return made.select(by, F.transform("v", lambda x: x["p"]).alias("vector"), "n", F.sqrt(F.lit(float(dim)) / F.col("n")).alias("snr"))
