"""Token counts of whole texts, by overlap resynchronisation for huge ones.

A huge text is encoded in overlapping chunks, with offsets. Two neighbouring chunks are spliced
at a common boundary: a place in the overlap where both have a token boundary and where a white
space follows something else. No token crosses such a place in any context (a pre-token can
hold white space only at its front, and a look-ahead sees one character), so tokens before it
from the left chunk and tokens after it from the right one are those of the whole text. Where
the overlap holds no such place, or the only one lies at the chunk's very end, it is widened
until it does or until the chunk reaches the end of the text.

Shorter texts are encoded by the library as they are, but the pieces between such places, which
recur, are encoded once per slice of the corpus.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is passed
through; repeated rows are counted each; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WHITE_SPACE, keyed_text, lean, text_slices

#: Texts of more characters are encoded in overlapping chunks of so many.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
SLICE_CHARS = 4_000_000
KEPT_PIECES = 400_000
LIMIT = 1024
PIECES = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
BORDER = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]")


class Library:
    """One face for the two libraries: counts of short texts, and token ends with offsets."""

    def __init__(self, name: str, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here
        self.by_pieces = name.endswith(".json")
        if self.by_pieces:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_str(data.decode())
            self.model.no_truncation()
            self.model.no_padding()
        else:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=data)

    def counts(self, texts: list[str]) -> list[int]:
        if self.by_pieces:
            return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(e) for e in self.model.encode(texts, num_threads=1)]

    def starts(self, text: str) -> list[int]:
        """The offset at which each token starts."""
        if self.by_pieces:
            return [a for a, _ in self.model.encode(text, add_special_tokens=False).offsets]
        begins = [p.begin for p in self.model.encode(text, return_type="proto").pieces]
        data = np.frombuffer(text.encode(), np.uint8)  # these offsets are in bytes
        of_byte = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, len(text))
        return of_byte[begins].tolist()


def spliced_count(text: str, starts_of, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of ``text``, from chunks spliced at stable common boundaries."""
    at, total, size = 0, 0, len(text)
    origin, left, left_end = 0, starts_of(text[:chunk]), min(size, chunk)
    while left_end < size:
        width = overlap
        while True:
            begin = max(at, left_end - width)
            right_end = min(size, begin + chunk + width)
            right = [begin + s for s in starts_of(text[begin:right_end])]
            both = set(left).intersection(right)
            # The last place may be changed by where the left chunk was cut; earlier ones can't.
            stable = [m.start() for m in BORDER.finditer(text, begin + 1, left_end - 1) if m.start() in both]
            if stable:
                break
            if begin == at:  # nothing to splice at in the whole chunk: it grows
                left_end = min(size, left_end + chunk)
                left = [origin + s for s in starts_of(text[origin:left_end]) if origin + s >= at]
                if left_end == size:
                    return total + len(left)
                width = overlap
            else:
                width *= 2
        border = stable[-1]
        total += sum(s < border for s in left)
        origin, at, left_end = begin, border, right_end
        left = [s for s in right if s >= border]
    return total + len(left)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every text, as the tokenizer in ``path`` counts."""
    with open(path, "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())  # the vocabulary: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(path, held.value)
        known: dict[str, int] = {}
        for ids, texts in text_slices(batches, SLICE_CHARS):
            counts = [0] * len(texts)
            small = [k for k, t in enumerate(texts) if len(t) <= CHUNK_CHARS]
            if library.by_pieces:
                cut = [PIECES.findall(texts[k]) for k in small]
                if len(known) > KEPT_PIECES:
                    known.clear()
                new = list(set().union(*cut).difference(known)) if cut else []
                known.update(zip(new, library.counts(new), strict=True))
                for k, pieces in zip(small, cut, strict=True):
                    counts[k] = sum(map(known.__getitem__, pieces))
            else:
                for k, n in zip(small, library.counts([texts[k] for k in small]), strict=True):
                    counts[k] = n
            for k, text in enumerate(texts):
                if len(text) > CHUNK_CHARS:
                    counts[k] = spliced_count(text, library.starts)
            columns = [pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return keyed_text(docs).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
