"""Keyed state over rows in order, the same for streams and batches: scrubbers of tags and spans, paced requests.

A step takes a key's state and one row and gives the new state and what to put out. ``folded`` runs it over a batch,
a key after the other in sorted partitions, holding the state and nothing else; ``stateful`` runs it over a stream,
with the state in the state store and a timer that ends keys which have gone quiet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

# Tags whose content is a model's own thought, and the tag of recalled context.
THOUGHT_TAGS = ("think", "thinking", "reasoning", "thought", "REASONING_SCRATCHPAD")
CONTEXT_TAGS = ("memory-context",)


@dataclass
class Scrubber:
    """Takes marked spans out of a text that arrives in pieces; what it lets through doesn't depend on the cuts.

    A tag opens a span at the start of a line (white space apart) and, with ``newline``, only if a line break follows;
    the span lasts until a tag closes it or the text ends. With ``pairs`` a tag elsewhere opens one too if it is closed
    within ``hold`` characters, so that much is held back at most; else it is prose. With ``orphans`` a closing tag
    that closes nothing goes, and the white space after it.
    """

    tags: tuple[str, ...] = THOUGHT_TAGS
    pairs: bool = True
    orphans: bool = True
    newline: bool = False
    hold: int = 4096
    _tag: re.Pattern = field(init=False, repr=False)

    def __post_init__(self):
        names = "|".join(map(re.escape, self.tags))
        self._open, self._close = re.compile(f"<(?:{names})>", re.I), re.compile(f"</(?:{names})>", re.I)
        self._starts = tuple({f"<{end}{t}>".lower()[:n] for t in self.tags for end in ("", "/") for n in range(1, len(t) + 3)})
        self._longest = max(map(len, self.tags)) + 3

    #: Held back, inside a span, only white space since the line began, white space goes.
    START = ("", False, True, False)

    def __call__(self, state: tuple, piece: str, last: bool = False) -> tuple[tuple, str]:
        held, inside, fresh, eating = state
        text, out, at = held + piece, [], 0

        def put(part: str) -> None:
            nonlocal fresh, eating
            if eating:
                part = part.lstrip()
                eating = not part
            if part:
                out.append(part)
                tail = part.rpartition("\n")[2]
                fresh = not tail.strip() and (fresh or "\n" in part)

        while at < len(text):
            if inside:
                if end := self._close.search(text, at):
                    at, inside = end.end(), False
                    continue
                cut = text.rfind("<", max(at, len(text) - self._longest))
                at = cut if cut >= 0 and not last and text[cut:].lower() in self._starts else len(text)
                break
            mark = text.find("<", at)
            if mark < 0:
                put(text[at:])
                at = len(text)
                break
            put(text[at:mark])
            at = mark
            if not last and len(text) - at < self._longest and text[at:].lower() in self._starts:
                break
            if self.orphans and (end := self._close.match(text, at)):
                at, eating = end.end(), True
                continue
            begin = self._open.match(text, at)
            if begin and fresh:
                if not self.newline or text[begin.end() : begin.end() + 1] == "\n":
                    at, inside, eating = begin.end(), True, False
                    continue
                if begin.end() == len(text) and not last:
                    break
            elif begin and self.pairs:
                end = self._close.search(text, begin.end())
                if end and end.start() <= begin.end() + self.hold:
                    at = end.end()
                    continue
                if not last and not end and len(text) <= begin.end() + self.hold + self._longest:
                    break
            stop = begin.end() if begin else at + 1
            put(text[at:stop])
            at = stop
        if last:
            return self.START, "".join(out)
        return (text[at:], inside, fresh, eating), "".join(out)


@dataclass
class Pacer:
    """A bucket of tokens that refills with time.

    A request passes if its tokens are there, and takes them; else it gets the seconds until they would be. A report of
    work done takes tokens without credit for the time the work took; a refusal by the other side empties the bucket.
    """

    capacity: float
    per_second: float

    START = (None, None)

    def __call__(self, state: tuple, kind: str, n: float, ts: float) -> tuple[tuple, tuple[bool, float]]:
        tokens, since = state
        tokens = self.capacity if tokens is None else tokens
        if kind == "report":
            return (max(0.0, tokens - n), ts), (True, 0.0)
        if since is not None:
            tokens = min(self.capacity, tokens + max(0.0, ts - since) * self.per_second)
        if kind == "refused":
            return (0.0, ts), (False, n / self.per_second)
        passed = tokens >= n
        return (tokens - n if passed else tokens, ts), (passed, 0.0 if passed else (n - tokens) / self.per_second)


Step = Callable[[tuple | None, Any], tuple[tuple, list[tuple]]]


def folded(rows: DataFrame, key: str, order: list[str], step: Step, end: Callable[[Any, tuple], list[tuple]], schema: str) -> DataFrame:
    """A batch: rows of a key in their order, then its end. Only the state of one key is held."""
    names = StructType.fromDDL(schema).fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                k = getattr(row, key)
                if state is not None and k != now:
                    out += end(now, state)
                    state = None
                now = k
                state, some = step(state, row)
                out += some
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(end(now, state), columns=names)

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class _Keyed(StatefulProcessor):
    def __init__(self, key: str, order: list[str], step: Step, end, schema: str, state: str, quiet_ms: int | None):
        self.key, self.order, self.step, self.end, self.names, self.kind, self.quiet_ms = key, order, step, end, StructType.fromDDL(schema).fieldNames(), StructType.fromDDL(state), quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.kind)

    def handleInputRows(self, key, rows, timerValues):
        state, out = (tuple(self.state.get()) if self.state.exists() else None), []
        for row in pd.concat(list(rows)).sort_values(self.order).itertuples(index=False):
            state, some = self.step(state, row)
            out += some
        self.state.update(state)
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = tuple(self.state.get()) if self.state.exists() else None
        self.state.clear()
        yield pd.DataFrame(self.end(key[0], state) if state is not None else [], columns=self.names)

    def close(self) -> None:
        pass


def stateful(rows: DataFrame, key: str, order: list[str], step: Step, end, schema: str, state: str, quiet_ms: int | None = None) -> DataFrame:
    """A stream: rows of a key come in order from one batch of the stream to the next; a key quiet for ``quiet_ms`` ends."""
    keyed = _Keyed(key, order, step, end, schema, state, quiet_ms)
    return rows.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(statefulProcessor=keyed, outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode="ProcessingTime" if quiet_ms is not None else "None")


SCRUBBED = "key string, seq long, visible string"
SCRUB_STATE = "held string, inside boolean, fresh boolean, eating boolean, seq long"


def _scrub_steps(scrubber: Scrubber):
    def step(state, row):
        known = (*scrubber.START, -1) if state is None else state
        after, shown = scrubber(tuple(known[:4]), row.piece or "", bool(row.last))
        return (*after, int(row.seq)), [(str(row.key), int(row.seq), shown)] if shown else []

    def end(key, state):
        _, shown = scrubber(tuple(state[:4]), "", True)
        return [(str(key), int(state[4]), shown)] if shown else []

    return step, end


def scrub(pieces: DataFrame, scrubber: Scrubber | None = None, quiet_ms: int | None = None) -> DataFrame:
    """key, seq and what is visible of the pieces (key, seq, piece, last) of each key's text, in a batch or a stream.

    ``last`` ends a text; the next piece of the key begins another one. A null piece is empty, rows without a key are left out.
    """
    step, end = _scrub_steps(scrubber or Scrubber())
    rows = pieces.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("piece").cast("string").alias("piece"), F.coalesce("last", F.lit(False)).alias("last"))
    if pieces.isStreaming:
        return stateful(rows, "key", ["seq"], step, end, SCRUBBED, SCRUB_STATE, quiet_ms)
    return folded(rows, "key", ["seq"], step, end, SCRUBBED)


PACED = "key string, event_id long, passed boolean, wait_s double"


def pace(requests: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """event_id, passed and wait of each request (key, event_id, ts, kind, n), in a batch or a stream: kind is request, report or refused."""
    pacer = Pacer(capacity, per_second)

    def step(state, row):
        after, (passed, wait) = pacer(pacer.START if state is None else state, row.kind, row.n, row.at)
        return after, [(row.key, row.event_id, passed, wait)] if row.kind == "request" else []

    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), at.alias("at"), F.col("kind"), F.col("n").cast("double").alias("n"))
    if requests.isStreaming:
        return stateful(rows, "key", ["at", "event_id"], step, lambda key, state: [], PACED, "tokens double, since double")
    return folded(rows, "key", ["at", "event_id"], step, lambda key, state: [], PACED)


def follow(spark, folder: str, level: str | None = None, component: str | None = None, most_files: int = 100) -> DataFrame:
    """Lines added to the log files of a folder, as a stream, with the filters of a tail: least level and component."""
    ranks = F.create_map(*[F.lit(x) for pair in zip(("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), range(5), strict=True) for x in pair])
    lines = spark.readStream.option("maxFilesPerTrigger", most_files).text(folder)
    fields = lines.select(F.col("value").alias("line"), F.regexp_extract("value", r"^(\S+ \S+)", 1).alias("at"), F.regexp_extract("value", r"\b(DEBUG|INFO|WARNING|ERROR|CRITICAL)\b", 1).alias("level"), F.regexp_extract("value", r"\b(?:DEBUG|INFO|WARNING|ERROR|CRITICAL)\b\s+([\w.]+)", 1).alias("component"))
    if level:
        fields = fields.where(F.try_element_at(ranks, F.col("level")) >= F.try_element_at(ranks, F.lit(level)))
    return fields.where((F.col("component") == component) | F.col("component").startswith(component + ".")) if component else fields
