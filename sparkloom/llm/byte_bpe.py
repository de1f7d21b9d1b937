"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A slice of the corpus is cut into pieces at places where a new match of the tokenizer's
pattern must begin (a white-space character after one that is none); distinct pieces are
encoded once. Encoding lays all distinct words end to end, builds an inverted index from the
rank of a pair of neighbouring symbols to the positions where it stands, and applies the merges
in rank order; each merge looks only at the neighbours it touches. No shuffle takes place:
each task replays the merges over its own part of the corpus, so lost executors cost only the
tasks they ran.

Defined cases: a null text is encoded as an empty one (0 tokens, digests of no bytes); a null
doc_id is passed through; repeated rows give repeated results; an empty table gives an empty
one; other columns are ignored. A text of one huge word costs time in proportion to its length
times a logarithm, as stale index entries are skipped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import WHITE_SPACE, keyed_text, lean, text_slices

#: Texts are replayed in slices of about so many characters.
SLICE_CHARS = 8_000_000
#: A task keeps the codes of so many distinct pieces at most, then starts anew.
KEPT_PIECES = 400_000
#: A piece can end only before white space that follows something else.
PIECES = f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class MergeReplay:
    """Replays the merges of a rank table over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        byte_ids = [ranks.get(bytes([b])) for b in range(256)]
        if None in byte_ids:
            raise ValueError("the rank table lacks single bytes")
        self.byte_id = np.array(byte_ids, np.int64)
        # Every way to put a token together from two: (left id, right id) -> id, sorted by key.
        pairs = {(ranks[t[:k]] << 32 | ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where they don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        joined = b"".join(words)
        total = len(joined)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        filled = sizes > 0
        last, first = ends[filled] - 1, (ends - sizes)[filled]
        symbol = self.byte_id[np.frombuffer(joined, np.uint8)]
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        after[last], before[first] = -1, -1
        rank = np.full(total, -1, np.int64)
        if total > 1:
            rank[:-1] = self._rank(symbol[:-1], symbol[1:])
        rank[last] = -1
        alive = np.ones(total, bool)
        seen = np.zeros(total, bool)
        odd = np.zeros(total, bool)  # where an earlier rank appeared between two merges of one

        index: dict[int, list[np.ndarray]] = {}  # rank of a pair -> positions where it stands
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            positions = positions[rank[positions] >= 0]
            if not len(positions):
                return
            ranks = rank[positions]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for r, a, b in zip(ranks[[0, *cuts]].tolist(), starts, starts[1:], strict=False):
                if r in index:
                    index[r].append(positions[a:b])
                else:
                    index[r] = [positions[a:b]]
                    heappush(heap, r)

        enter(np.flatnonzero(rank >= 0))
        while heap:
            current = heappop(heap)
            found = index.pop(current)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[rank[at] == current]
            if not len(at):
                continue
            right = after[at]
            clash = rank[right] == current
            if clash.any():  # a run of one symbol: every other pair of it, from the left
                at.sort()
                taken, kept = set(), []
                for i, j in zip(at.tolist(), after[at].tolist(), strict=True):
                    if i not in taken:
                        kept.append(i)
                        taken.add(j)
                at = np.array(kept, np.int64)
                right = after[at]
            beyond, back = after[right], before[at]
            has_next, has_back = beyond >= 0, back >= 0
            soon = np.full(len(at), -1, np.int64)
            soon[has_next] = self._rank(np.full(int(has_next.sum()), current), symbol[beyond[has_next]])
            odd[at[(soon >= 0) & (soon < current)]] = True
            symbol[at] = current
            alive[right] = False
            rank[right] = -1
            after[at] = beyond
            before[beyond[has_next]] = at[has_next]
            rank[at] = -1
            live = at[has_next]
            rank[live] = self._rank(symbol[live], symbol[after[live]])
            left = before[at[has_back]]
            seen[live] = True
            left = left[~seen[left]]
            seen[live] = False
            rank[left] = made = self._rank(symbol[left], symbol[after[left]])
            odd[left[(made >= 0) & (made < current)]] = True
            enter(live)
            enter(left)

        ids = symbol[alive].astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] * 4
        data, bounds = ids.tobytes(), bounds.tolist()
        out = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        if odd.any():
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(odd), side="right")).tolist():
                out[k] = self._alone(words[k])
        return out

    def _alone(self, word: bytes) -> bytes:
        """One word by itself: the least rank of its pairs first, whichever merge made it."""
        parts = [word[i : i + 1] for i in range(len(word))]
        n = len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        of = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := of(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i] if parts[i] is a else -1
            if j < 0 or parts[j] is not b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := of(parts[x] + parts[y])) is not None:
                    heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([of(p) for p in parts if p is not None], "<u4").tobytes()


class Codec:
    """Encodes and decodes texts; keeps the codes of distinct pieces within a bound."""

    kept = KEPT_PIECES

    def __init__(self, ranks: dict[bytes, int] | MergeReplay, pattern: str):
        self.replay = ranks if isinstance(ranks, MergeReplay) else MergeReplay(ranks)
        ranks = self.replay.ranks
        self.word = regex.compile(pattern)
        self.piece = re.compile(PIECES)
        self.codes: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_data = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        cut = [self.piece.findall(text) for text in texts]
        if len(self.codes) > self.kept:
            self.codes.clear()
        new = set().union(*cut).difference(self.codes) if cut else set()
        self._learn(new)
        code = self.codes.__getitem__
        return [b"".join(map(code, pieces)) for pieces in cut]

    def _learn(self, pieces: set[str]) -> None:
        if len(self.words) > self.kept:
            self.words.clear()
        split: list[tuple[str, list[str]]] = []
        plain = [p for p in pieces if p[0] == " " and not p[-1].isspace()]
        # These end where a match ends whatever follows, so one search over all of them will do.
        found, at = self.word.findall("".join(plain)), 0
        for piece in plain:
            if len(found[at]) == len(piece):
                split.append((piece, found[at : at + 1]))
                at += 1
                continue
            begin, size = at, 0
            while size < len(piece):
                size += len(found[at])
                at += 1
            split.append((piece, found[begin:at]))
        split += [(p, self.word.findall(p)) for p in pieces.difference(plain)]
        new = list({w for _, words in split for w in words}.difference(self.words))
        self.words.update(zip(new, self.replay.encode([w.encode() for w in new]), strict=True))
        code = self.words
        for piece, words in split:
            self.codes[piece] = code[words[0]] if len(words) == 1 else b"".join([code[w] for w in words])

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for, gathered from one table of all tokens."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        size = self.token_size[ids]
        ends = np.cumsum(size)
        data = self.token_data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.token_start[ids] - ends + size, size)].tobytes()
        last = np.concatenate([[0], ends])[np.cumsum([0, *map(len, coded)]) // 4].tolist()
        return [data[a:b] for a, b in zip(last, last[1:], strict=False)]


def _with_codec(spark, path: str, pattern: str, row, schema: str, slice_chars: int = SLICE_CHARS, kept: int = KEPT_PIECES):
    # The vocabulary and its pairs: of fixed size, and made once, not by every task.
    replay = spark.sparkContext.broadcast(MergeReplay(load_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(replay.value, pattern)
        codec.kept = kept
        for ids, texts in text_slices(batches, slice_chars):
            columns = row(codec, ids, codec.encode(texts))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return lambda df: df.mapInArrow(lean(run), schema)


def _lists(coded: list[bytes]) -> pa.Array:
    return pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in coded], pa.list_(pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of each text."""

    def row(codec, ids, coded):
        return {"doc_id": pa.array(ids, pa.int64()), "ids": _lists(coded)}

    return _with_codec(docs.sparkSession, path, pattern, row, "doc_id long, ids array<int>")(keyed_text(docs))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each list of token ids; bytes that are no UTF-8 are replaced."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches):
        of = {rank: token for token, rank in ranks.value.items()}
        for batch in batches:
            texts = [b"".join(of[i] for i in ids or ()).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, slice_chars: int = SLICE_CHARS, kept: int = KEPT_PIECES) -> DataFrame:
    """Encode and decode every text: n_tokens and digests of the ids and of the decoded bytes; the ids if wanted.

    Shorter slices and fewer kept pieces take less memory and more time.
    """

    def row(codec, ids, coded):
        digest = lambda data: hashlib.sha256(data).hexdigest()
        out = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64()),
            "ids_sha256": pa.array([digest(c) for c in coded], pa.string()),
            "decoded_sha256": pa.array(list(map(digest, codec.decode(coded))), pa.string()),
        }
        return out | ({"ids": _lists(coded)} if with_ids else {})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _with_codec(docs.sparkSession, path, pattern, row, schema, slice_chars, kept)(keyed_text(docs))
