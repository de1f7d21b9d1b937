"""Suffix order through a threshold: byte strings of a fixed length that start at two places or more are found and cut.

Suffixes are ordered by their first ``threshold`` bytes only, by passes over digits, the most significant first,
and every pass drops the groups of one; groups that reach the last pass are exactly the repeated strings.
The first digit of a window is the piece of ``piece`` bytes in it that hashes least (the leftmost of equal ones),
which depends on the window's bytes alone. Windows side by side mostly share it and travel as one row. Later
digits reach out from that piece: the bytes that ``step`` neighbouring windows have in common, then all bytes.
A row all of whose windows are found elsewhere in the same row of bytes is settled at once, and one of each
sort of settled rows stays as a witness for what is still open. Groups are counted by aggregation, with sums
made in the tasks, and no group is gathered in one place. Nothing is broadcast but the list of hot keys.

Defined cases: a null text is empty; texts shorter than the threshold keep all their bytes; a null or repeated
doc_id is a document like others, since texts are known by their MD5 here; copies of a text repeat all of it.
Equality of windows is that of their 128-bit BLAKE2b digests. Other columns don't matter.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, discard, join_hot, lean, settle, short_batches

THRESHOLD = 200
PIECE = 57
#: Bytes that are hashed at once.
SLICE = 1 << 19

ROWS = "text_key binary, lo long, windows int, at int, core long, full binary, weight long"
ARROW = pa.schema([("text_key", pa.binary()), ("lo", pa.int64()), ("windows", pa.int32()), ("at", pa.int32()), ("core", pa.int64()), ("full", pa.binary()), ("weight", pa.int64())])


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _short(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


class Anchors:
    """The windows of some bytes by their first digit."""

    def __init__(self, threshold: int, piece: int, most: int):
        self.threshold, self.piece, self.span = threshold, piece, threshold - piece + 1
        base = 0x9E3779B97F4A7C15
        self.values = np.random.default_rng(13).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        powers = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(most, b, dtype=np.uint64))])
        self.power, self.inverse = powers(base), powers(pow(base, -1, 2**64))

    def __call__(self, data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and last window, the piece's place and its hash, of each row of windows among the ``valid`` starts."""
        n, span = len(data), self.span
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[:n], out=sums[1:])
        hashes = (sums[self.piece :] - sums[: n + 1 - self.piece]) * self.inverse[: n + 1 - self.piece]
        bits = np.uint64((1 << n.bit_length()) - 1)
        keys = np.full(-(-len(hashes) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        keys[: len(hashes)] = (hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64)
        blocks = keys.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - self.threshold + 1
        least = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & bits)[valid].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        at = least[first]
        return valid[first], valid[last], at, hashes[at].view(np.int64)


def _first_pass(threshold: int, piece: int, slice_bytes: int):
    """Rows of windows with their first digit; what a slice has twice is settled here (a row without digits)."""

    def run(batches):
        anchors = Anchors(threshold, piece, 2 * slice_bytes + threshold)
        held: list[tuple[bytes, int, bytes]] = []
        size = 0

        def flush():
            data = b"".join(x for _, _, x in held)
            lengths = np.array([len(x) for _, _, x in held])
            ends = np.cumsum(lengths)
            begins = ends - lengths
            valid = np.concatenate([np.arange(b, e - threshold + 1) for b, e in zip(begins, ends, strict=True)])
            lo, hi, at, core = anchors(np.frombuffer(data, np.uint8), valid)
            full = np.array([_digest(data[a:b]) for a, b in zip(lo.tolist(), (hi + threshold).tolist(), strict=True)], dtype=object)
            code, _ = pd.factorize(full)
            times = np.bincount(code)[code]
            once = ~pd.Series(code).duplicated().to_numpy()
            which = np.searchsorted(ends, lo, side="right")
            offset = np.array([o for _, o, _ in held]) - begins
            names = np.array([k for k, _, _ in held], dtype=object)
            own = which[once]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[own], pa.binary()), pa.array(lo[once] + offset[own]), pa.array((hi - lo + 1)[once], pa.int32()), pa.array((at - lo)[once], pa.int32()), pa.array(core[once]), pa.array(full[once], pa.binary()), pa.array(times[once])],
                schema=ARROW,
            )
            twice = np.flatnonzero(times > 1)
            if len(twice):
                a, b, w = lo[twice], hi[twice], which[twice]
                starts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (a[1:] != b[:-1] + 1)]))
                stops = np.concatenate([starts[1:], [len(twice)]]) - 1
                a, b, w, none = a[starts], b[stops], w[starts], pa.nulls(len(starts))
                yield pa.RecordBatch.from_arrays([pa.array(names[w], pa.binary()), pa.array(a + offset[w]), pa.array(b - a + 1, pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64())], schema=ARROW)
            held.clear()

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = key.as_py(), text.as_py()
                windows = len(text) - threshold + 1
                for begin in range(0, windows, slice_bytes):
                    part = text[begin : min(begin + slice_bytes, windows) + threshold - 1]
                    held.append((key, begin, part))
                    size += len(part)
                    if size >= slice_bytes:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    return run


def _dealt(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with a lookup. Both carry ``most``, which no key has more rows than; rows of a key that may have many go to parts."""
    parts = F.ceil(F.col("most") / HOT_ROWS)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts))
    copies = lookup.select(key, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    return rows.join(copies, [key, "_part"]).drop("_part")


def _classes(rows: DataFrame, *names: str) -> DataFrame:
    """How many rows are equal, and one of them, by their digits."""
    return settle(rows.groupBy("core", "full").agg(F.sum("weight").alias("n"), F.max("most").alias("most"), F.min(F.struct("text_key", *names)).alias("one")), "repeats-classes")


def _open(classes: DataFrame) -> DataFrame:
    """One row of each class of equal rows in a group that has an unsettled one and another."""
    groups = classes.groupBy("core").agg(F.count("*").alias("sorts"), F.min("n").alias("least"), F.max("most").alias("most")).where("sorts > 1 and least = 1")
    groups = settle(groups.select("core", "most"), "repeats-open")
    out = settle(_dealt(classes, groups, "core").select("one.*", F.least("n", F.lit(2)).cast("long").alias("weight"), "most"), "repeats-next")
    discard(groups)
    return out


def _settled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows whose class has another one."""
    return settle(_dealt(rows.select("text_key", "lo", "windows", "full", "most"), classes.where("n > 1"), "full").select("text_key", "lo", "windows"), "repeats-found")


def _segments(docs: DataFrame, asked: DataFrame, threshold: int) -> DataFrame:
    """The bytes of the asked rows of windows, from one copy of each text."""
    lists = settle(asked.groupBy("text_key").agg(F.collect_list(F.struct("lo", "windows", "at", "weight", "most")).alias("asked")), "repeats-asked")

    def cut(batches):
        seen = set()
        for batch in batches:
            rows = []
            for key, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key not in seen:
                    seen.add(key)
                    rows += [(key, p["lo"], p["windows"], p["at"], p["weight"], p["most"], text[p["lo"] : p["lo"] + p["windows"] - 1 + threshold]) for p in places]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["text_key", "base", "windows", "at", "weight", "most", "bytes"])

    rows = join_hot(docs, lists, ["text_key"], None).select("text_key", "bytes", "asked")
    out = rows.mapInArrow(lean(cut), "text_key binary, base long, windows int, at int, weight long, most long, bytes binary")
    out = settle(out.dropDuplicates(["text_key", "base"]), "repeats-segments")
    discard(lists)
    return out


def _second_pass(threshold: int, piece: int, step: int):
    """Rows of at most ``step`` windows of each segment, cut at fixed distances from the piece."""
    widest = threshold - piece

    def run(batches):
        for batch in batches:
            rows = []
            for key, base, windows, at, weight, most, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for cell in range((at - windows + 1) // step, at // step + 1):
                    near, far = cell * step, min(cell * step + step - 1, widest)
                    first, last = max(0, at - far), min(windows - 1, at - near)
                    core = data[at - near : at - far + threshold]
                    rows.append((key, base, base + first, last - first + 1, _short(core), _digest(data[first : last + threshold]), weight, most))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["text_key", "base", "lo", "windows", "core", "full", "weight", "most"])

    return run


def _last_pass(threshold: int):
    """Each window of the asked rows by all its bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, base, data, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in asked:
                    rows += [(key, x["lo"] + k, 1, _digest(data[x["lo"] - base + k : x["lo"] - base + k + threshold]), x["weight"], x["most"]) for k in range(x["windows"])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["text_key", "lo", "windows", "full", "weight", "most"])

    return run


def keyed_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, the bytes of the text, and the key by which equal texts are one."""
    short_batches(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("bytes"))


def repeated(docs: DataFrame, threshold: int = THRESHOLD, piece: int | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """text_key, spans: for each text with repeated windows, the (start, stop) in bytes of rows of them."""
    piece = piece or max(1, threshold * PIECE // THRESHOLD)
    step = math.isqrt(threshold - piece) + 1
    rows = keyed_bytes(docs).where(F.octet_length("bytes") >= threshold).select("text_key", "bytes")
    found = settle(rows.mapInArrow(lean(_first_pass(threshold, piece, slice_bytes)), ROWS), "repeats-first")
    spans = [settle(found.where("core is null").select("text_key", "lo", "windows"), "repeats-found")]
    digits = found.where("core is not null")
    twice = settle(digits.groupBy("core").agg(F.sum("weight").alias("most")).where("most > 1"), "repeats-cores")
    alive = settle(join_hot(digits, twice, ["core"], None, counts=twice.select("core", F.col("most").alias("_n"))), "repeats-alive")
    discard(found, twice)
    classes = _classes(alive, "lo", "windows", "at")
    spans.append(_settled(alive, classes))
    discard(alive)
    asked = _open(classes)
    discard(classes)

    segments = _segments(rows, asked, threshold)
    discard(asked)
    cells = settle(segments.mapInArrow(_second_pass(threshold, piece, step), "text_key binary, base long, lo long, windows int, core long, full binary, weight long, most long"), "repeats-cells")
    parts = _classes(cells, "base", "lo", "windows")
    spans.append(_settled(cells, parts))
    left = _open(parts)
    discard(cells, parts)

    lists = left.groupBy("text_key", "base").agg(F.collect_list(F.struct("lo", "windows", "weight", "most")).alias("asked"))
    windows = segments.select("text_key", "base", "bytes").join(lists, ["text_key", "base"])
    windows = settle(windows.mapInArrow(_last_pass(threshold), "text_key binary, lo long, windows int, full binary, weight long, most long"), "repeats-windows")
    discard(segments, left)
    same = settle(windows.groupBy("full").agg(F.sum("weight").alias("n"), F.max("most").alias("most")).where("n > 1"), "repeats-same")
    spans.append(_settled(windows, same))
    discard(windows, same)

    every = spans[0]
    for some in spans[1:]:
        every = every.unionByName(some)
    every = every.distinct().groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct(F.col("lo").alias("start"), (F.col("lo") + F.col("windows") - 1 + threshold).alias("stop")))).alias("spans"))
    out = settle(every, "repeats-spans")
    discard(*spans)
    return out


def cut(docs: DataFrame, threshold: int = THRESHOLD, **how) -> DataFrame:
    """doc_id, n_bytes, removed (the maximal spans of bytes that repeated strings cover) and kept (the other bytes)."""
    spans = repeated(docs, threshold, **how)

    def keep(batches):
        for batch in batches:
            removed, kept = [], []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                text, merged = text.as_py(), []
                for p in places.as_py() or ():
                    if merged and p["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], p["stop"])
                    else:
                        merged.append(dict(p))
                edges = [0, *(x for p in merged for x in (p["start"], p["stop"])), len(text)]
                removed.append(merged)
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in batch.column(1).to_pylist()], long), pa.array(removed, pa.list_(pa.struct([("start", long), ("stop", long)]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"]
            )

    rows = join_hot(keyed_bytes(docs), spans, ["text_key"], None, "left")
    return rows.select("doc_id", "bytes", "spans").mapInArrow(lean(keep), "doc_id long, n_bytes long, removed array<struct<start: long, stop: long>>, kept binary")
