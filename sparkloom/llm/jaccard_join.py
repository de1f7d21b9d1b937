"""N-gram Jaccard self-join by universe-partition pigeonhole; components of its links.

A document's set holds its distinct word shingles. Copies are merged over the whole corpus by a
128-bit digest of their sets, so one document signs for all of them. Sets are put in size bands
so that linked ones are at most a band apart. For a band with sets of up to s shingles, linked
sets differ in at most H = floor(2 s (1 - t) / (1 + t)) of them. Shingles are hashed into e
segments that are compared exactly and d that may have one difference, with e + 2 d = H + k: what
agrees counts k or more, an exact segment one and the other kind two. So two linked sets agree in
a one-deletion segment, or in k exact ones, of which the highest in any order of segment contents
isn't among the k - 1 lowest of either set: those need no signature. The order puts small
segments first, so empty ones, which many sets share by chance, are left out. An exact segment
gives one signature; the other kind one more for each deletion of a shingle in it. Which split of
e and d a band gets is decided by its cost on a bounded sample (signatures written, pairs that
collide); the choice affects time alone.

Each task groups the signatures of its chunk of documents first and sends one row for each to the
others, so a signature that a third of all sets share is as many rows as there are chunks.

Candidates are verified exactly, without making all pairs of a group: each set is first held
against the least set of the bucket it shares most signatures with, then against the other
buckets' least sets where the components found so far differ; what shares a bucket and still has
different components is joined by its differences from a common centre (``_by_difference``). No
link between components is lost. Texts are compared only of pairs whose sketches, a byte for each
segment, leave a link possible: segments that differ are a lower bound on shingles that do.

Defined cases: a null text or one without words has an empty set and is linked with nothing;
fewer words than a shingle form one; rows of one doc_id are one document whose texts may each
link it; a row with a null doc_id has a null component and no links; copies are one set; an
empty table gives an empty one; other columns are ignored by ``join`` and kept by ``one_each``,
which keeps one of rows equal in doc_id and text, and every row whose doc_id is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, discard, join_hot, keyed_text, lean, settle
from .components import apart, components, extended

WORDS, PERCENT = 3, 90
#: Sets that the allocation is decided on, at most about; what a colliding pair costs in signatures.
SAMPLE, PAIR_COST = 4000, 4
#: Spare segments: one for each so many differences, so that a band's lowest segments need no signature.
SPARE = 4
#: Rows of the batches that signatures go out in.
OUT_ROWS = 20_000
#: Signatures that a task groups at a time.
CHUNK = 500_000
KEPT_CENTRES = 64
#: Bytes of texts that are shingled at a time, about; words of more bytes than this are hashed each by itself.
SLICE_BYTES, LONG_WORD = 300_000, 64
#: Characters of centres' texts that are broadcast, at most.
BROADCAST_TEXT = 16_000_000
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: The first bytes of eight.
_FRONT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _K[0]
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of a text, made for many texts at a time."""

    def __init__(self, words: int):
        self.n = words

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode(errors="surrogatepass") + b" "
        return self._sets(raw, np.array([0, len(raw)]))[0]

    def column(self, texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[list[np.ndarray]]:
        """The sets of a column's texts, in slices of about ``size`` bytes."""
        empty, space = (pa.scalar(x, pa.large_binary()) for x in (b"", b" "))
        ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_binary()), empty), empty, space)
        ends = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
        at = 0
        while at < len(ended):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
            raw = ended.buffers()[2][int(ends[at]) : int(ends[to])].to_pybytes()
            yield self._sets(raw, ends[at : to + 1] - ends[at])
            at = to

    def _sets(self, raw: bytes, ends: np.ndarray) -> list[np.ndarray]:
        """``raw`` holds texts that end in a space each; where they begin and the last one ends."""
        starts, h = word_hashes(raw.lower())
        bounds = np.searchsorted(starts, ends).tolist()
        whole, out = self._hashed(h, self.n), []
        for at, to in zip(bounds, bounds[1:], strict=False):
            few = to - at < self.n
            found = np.sort(self._hashed(h[at:to], to - at) if few else whole[at : to - self.n + 1])
            if len(found) > 1:
                found = found[np.r_[True, found[1:] != found[:-1]]]
            out.append(found)
        return out

    @staticmethod
    def _hashed(h: np.ndarray, n: int) -> np.ndarray:
        """The hash of ``n`` words from each place on."""
        if not n or len(h) < n:
            return np.zeros(0, np.uint64)
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out ^ h[k : len(h) - n + 1 + k])
        return out


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places and hashes of the words of ``raw``, which ends in white space; eight bytes are mixed in at a time."""
    codes = np.frombuffer(raw + bytes(8), np.uint8)
    inside = np.zeros(len(raw) + 1, bool)
    inside[1:] = (codes[: len(raw)] - np.uint8(9) > 4) & (codes[: len(raw)] != 32)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    lanes = np.ndarray(len(raw) + 1, "<u8", codes, strides=(1,))
    h = mix(mix(lengths.astype(np.uint64)) ^ (lanes[starts] & _FRONT[np.minimum(lengths, 8)]))
    more = np.flatnonzero(lengths > 8)
    for k in range(8, LONG_WORD, 8):
        more = more[lengths[more] > k]
        h[more] = mix(h[more] ^ (lanes[starts[more] + k] & _FRONT[np.minimum(lengths[more] - k, 8)]))
    for k in more[lengths[more] > LONG_WORD].tolist():
        h[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + lengths[k]])
    return starts, h


def band_edges(percent: int, largest: int) -> list[int]:
    """The least size of each band: a size linked with it is in its band or the one before."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return edges


class Signer:
    """Signatures of sets; ``share`` says for a band how much of the difference one-deletion segments take."""

    def __init__(self, percent: int, share=lambda band: 0.0):
        self.percent, self.share, self.edges = percent, share, band_edges(percent, 1 << 12)

    def segments(self, band: int, share: float | None = None) -> tuple[int, int, int]:
        """(segments up to one deletion, exact segments, lowest exact ones left out) of a band."""
        most = (2 * (self.edges[band + 1] - 1) * (100 - self.percent)) // (100 + self.percent)
        d = int((self.share(band) if share is None else share) * ((most + 2) // 2))
        e = max(0, most + 1 - 2 * d)
        spare = e // SPARE
        return d, e + spare, spare

    def band(self, size: int) -> int:
        if size >= self.edges[-3]:
            self.edges = band_edges(self.percent, 2 * size)
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def _cut(self, items: np.ndarray, band: int, n: int, row: np.ndarray | None = None):
        """(mixed shingles by segment, their segments, sizes, contents) for ``n`` segments, of each set where ``row`` tells sets apart."""
        salt = np.uint64((band * 2 + 1) * int(_K[0]) % (1 << 64))
        mixed = mix(items ^ salt)
        segment = ((mixed >> np.uint64(24)) % np.uint64(n)).astype(np.int64)
        total = n
        if row is not None:
            segment, total = segment + row * n, n * (int(row[-1]) + 1)
        order = np.argsort(segment.astype(np.uint16) if total <= 1 << 16 else segment, kind="stable")
        mixed, segment = mixed[order] * _K[1] + _K[2], segment[order]
        sums = np.zeros(total, np.uint64)
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sums[segment[first]] = np.add.reduceat(mixed, first)
        of = np.arange(n, dtype=np.uint64) * _K[2] + salt
        return mixed, segment, np.bincount(segment, minlength=total), sums, mix(of)

    def __call__(self, items: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(band, signatures) in a set's own band and the next."""
        out = []
        own = self.band(len(items))
        for band in (own, own + 1):
            d, e, spare = self.segments(band)
            mixed, segment, sizes, sums, of = self._cut(items, band, d + e)
            whole = mix(sums ^ of)
            exact = whole[d:]
            if spare:
                exact = exact[np.lexsort((exact, sizes[d:]))[spare:]]
            inside = segment < d
            less = mix((sums[segment[inside]] - mixed[inside]) ^ of[segment[inside]])
            out.append((band, np.concatenate([whole[:d], exact, less]).view(np.int64)))
        return out

    def all(self, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of sets, signatures) of many sets that aren't empty, those of a band at a time."""
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        own = np.fromiter(map(self.band, size.tolist()), np.int64, len(sets))
        for band in np.unique(np.r_[own, own + 1]).tolist():
            at = np.flatnonzero((own == band) | (own == band - 1))
            d, e, spare = self.segments(band)
            n, row = d + e, np.repeat(np.arange(len(at)), size[at])
            mixed, segment, sizes, sums, of = self._cut(np.concatenate([sets[k] for k in at.tolist()]), band, n, row)
            by_set = sums.reshape(-1, n)
            whole = mix(by_set ^ of)
            exact = whole[:, d:]
            if spare:
                exact = np.take_along_axis(exact, np.lexsort((exact, sizes.reshape(-1, n)[:, d:]))[:, spare:], 1)
            yield np.repeat(at, d + exact.shape[1]), np.hstack([whole[:, :d], exact]).ravel().view(np.int64)
            if d:
                inside = segment % n < d
                segment = segment[inside]
                yield at[segment // n], mix((sums[segment] - mixed[inside]) ^ of[segment % n]).view(np.int64)

    def sketch(self, items: np.ndarray) -> tuple[int, bytes, bytes]:
        """A set's band, and a byte for each segment of it and of the next."""
        own = self.band(len(items))
        low, high = (mix(self._cut(items, band, sum(self.segments(band, 0.0)[:2]))[3]).astype(np.uint8).tobytes() for band in (own, own + 1))
        return own, low, high


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _allocation(keyed: DataFrame, n: int, words: int, percent: int) -> dict[int, float]:
    """For each band of a sample of ``n`` rows, the share of one-deletion segments that costs least."""
    share = min(1.0, SAMPLE / max(n, 1))
    sample = keyed.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    choices = (0.0, 0.5, 1.0)

    def run(batches):
        shingle, seen = Shingler(words), set()
        signers = [Signer(percent, lambda _, c=c: c) for c in choices]
        for _, text in _pairs_of(batches):
            items = shingle(text)
            if not len(items) or (key := items.tobytes()) in seen or len(seen) > SAMPLE:
                continue
            seen.add(key)
            for c, signer in zip(choices, signers, strict=True):
                for band, sigs in signer(items):
                    n = len(sigs)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c)), pa.array(np.full(n, band, np.int32)), pa.array(sigs)], ["choice", "band", "sig"])

    counts = sample.mapInArrow(lean(run), "choice double, band int, sig long").groupBy("choice", "band", "sig").agg(F.count("*").alias("n"))
    cost = counts.groupBy("band", "choice").agg((F.sum("n") + PAIR_COST * F.sum(F.col("n") - 1)).alias("cost"))  # a bucket is held against its head
    best: dict[int, tuple[float, float]] = {}
    for row in cost.collect():  # a few rows for each band
        best[row["band"]] = min(best.get(row["band"], (float("inf"), 0.0)), (row["cost"], row["choice"]))
    return {band: choice for band, (_, choice) in best.items()}


def _sets(keyed: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and the digest (h1, h2) of each row's set."""

    def run(batches):
        shingle = Shingler(words)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, digests = [], []
            for slice_sets in shingle.column(batch.column(1)):
                sizes += map(len, slice_sets)
                digests += map(xxhash.xxh128_digest, slice_sets)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "n_shingles", "h1", "h2"])

    return keyed.mapInArrow(lean(run), "doc_id long, n_shingles long, h1 long, h2 long")


def _merged(sets: DataFrame) -> DataFrame:
    """doc_id, n_shingles and rep, the least doc_id with the same set; null for an empty one."""
    copies = sets.where("doc_id is not null and n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    copies = settle(copies.where("rep < last").drop("last"), "jj-copies")
    rep = F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id"))
    out = settle(join_hot(sets, copies, ["h1", "h2"], copies.count(), "left").select("doc_id", "n_shingles", rep.alias("rep")), "jj-merged")
    discard(copies)
    return out


def _signatures(texts: DataFrame, allocation: dict[int, float], words: int, percent: int, chunk: int) -> DataFrame:
    """(sig, of, doc): for each signature of a chunk its least document, of being null, and where it has more, all of them, of being the least."""

    def grouped(sigs, docs):
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        order = np.argsort(sig)
        sig, doc = sig[order], doc[order]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        n, head = np.diff(np.r_[first, len(sig)]), np.minimum.reduceat(doc, first)
        many = np.repeat(n > 1, n)
        of = pa.concat_arrays([pa.nulls(len(first), pa.int64()), pa.array(np.repeat(head, n)[many])])
        out = pa.RecordBatch.from_arrays([pa.array(np.r_[sig[first], sig[many]]), of, pa.array(np.r_[head, doc[many]])], ["sig", "of", "doc"])
        return [out.slice(k, OUT_ROWS) for k in range(0, out.num_rows, OUT_ROWS)]

    def run(batches):
        shingle, signer = Shingler(words), Signer(percent, lambda b: allocation.get(b, 0.0))
        sigs, docs, size = [], [], 0
        for batch in batches:
            keys, at = batch.column(0).to_numpy(), 0
            for sets in shingle.column(batch.column(1), min(SLICE_BYTES, 8 * chunk)):
                full = [k for k, items in enumerate(sets) if len(items)]
                for place, own in signer.all([sets[k] for k in full]):
                    sigs.append(own)
                    docs.append(keys[at:][full][place])
                    size += len(own)
                at += len(sets)
                if size >= chunk:
                    yield from grouped(sigs, docs)
                    sigs, docs, size = [], [], 0
        if size:
            yield from grouped(sigs, docs)

    return texts.mapInArrow(lean(run), "sig long, of long, doc long")


def _buckets(signatures: DataFrame) -> DataFrame:
    """sig, head, doc of what shares a signature, a bucket's head among its docs.

    The head is the least document of all, or of a chunk for what the chunk had grouped. Rows of a
    partition come in order, so a bucket of any size is passed on as it streams by.
    """

    def run(batches):
        last = None  # the bucket's row that rows to come belong to, and whether it was passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(1)
            member = of.is_valid().to_numpy(zero_copy_only=False)
            sig, doc = (batch.column(k).to_numpy() for k in (0, 2))
            parts = [(sig[member], of.drop_null().to_numpy(), doc[member])]
            sig, doc = sig[~member], doc[~member]
            if last is not None:
                sig, doc = np.r_[np.int64(last[0]), sig], np.r_[np.int64(last[1]), doc]
            if len(sig):
                first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
                n = np.diff(np.r_[first, len(sig)])
                passed, head = np.repeat(n > 1, n), np.repeat(doc[first], n)
                done = last is not None and last[2]
                last = (sig[first[-1]], doc[first[-1]], bool(n[-1] > 1) or (done and len(first) == 1))
                if done:
                    passed[0] = False
                parts.append((sig[passed], head[passed], doc[passed]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["sig", "head", "doc"])

    dealt = signatures.repartition("sig", "of").sortWithinPartitions("sig", "of", "doc")
    return settle(dealt.mapInArrow(lean(run), "sig long, head long, doc long"), "jj-buckets")


def _possible(pairs: DataFrame, keyed: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that the sketches of their texts leave possible."""
    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jj-ids")
    few = ids.count() <= BROADCAST_IDS

    def sketches(batches):
        shingle, signer = Shingler(words), Signer(percent)
        for batch in batches:
            found = (items for sets in shingle.column(batch.column(1)) for items in sets)
            rows = [(key, len(items), *signer.sketch(items)) for key, items in zip(batch.column(0).to_pylist(), found, strict=True) if len(items)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "n", "band", "low", "high"])

    texts = keyed.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    made = settle(texts.mapInArrow(lean(sketches), "doc_id long, n long, band int, low binary, high binary"), "jj-sketches")
    left, right = (made.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "band", "low", "high")]) for x in "ab")

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y, n, m, p, q, low, high, other_low, other_high in _pairs_of([batch]):
                if abs(p - q) > 1:
                    continue
                one, two = low if p >= q else high, other_low if q >= p else other_high
                apart = np.count_nonzero(np.frombuffer(one, np.uint8) != np.frombuffer(two, np.uint8))
                if (100 + percent) * max(apart, abs(n - m)) <= (100 - percent) * (n + m):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    pairs_few = pairs.count() <= BROADCAST_IDS
    both = _beside(pairs, left, "a", pairs_few).join(right, "b").select("a", "b", "n_a", "n_b", "band_a", "band_b", "low_a", "high_a", "low_b", "high_b")
    out = settle(both.mapInArrow(lean(run), "a long, b long").distinct(), "jj-possible")
    discard(ids, made)
    return out


def _beside(rows: DataFrame, wide: DataFrame, key: str, few: bool) -> DataFrame:
    """``rows`` of ids with the columns of a wide table, which isn't moved where the rows are few."""
    return wide.join(F.broadcast(rows) if few else rows, key)


def _linked(pairs: DataFrame, keyed: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts link, verified exactly."""
    pairs = _possible(pairs, keyed, words, percent)
    few = pairs.count() <= BROADCAST_IDS
    left = _beside(pairs, keyed.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a", few)
    ids = pairs.select("b").distinct()
    right = keyed.select(F.col("doc_id").alias("b"), F.col("text").alias("right")).join(F.broadcast(ids) if few else ids, "b", "left_semi")

    def run(batches):
        shingle, last, items = Shingler(words), None, None
        for batch in batches:
            a, b = [], []
            for x, y, one, two in _pairs_of([batch]):
                if two != last:
                    last, items = two, shingle(two)
                own = shingle(one)
                if not len(own) or not len(items):
                    continue
                small, big = (own, items) if len(own) <= len(items) else (items, own)
                if len(small) * 100 < percent * len(big):
                    continue
                at = np.searchsorted(big, small)
                both = int((big[np.minimum(at, len(big) - 1)] == small).sum())
                if 100 * both >= percent * (len(own) + len(items) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    both = left.join(right, "b").select("a", "b", "left", "right")
    out = settle(both.mapInArrow(lean(run), "a long, b long"), "jj-links")
    discard(pairs)
    return out


def _centres(first: DataFrame) -> DataFrame:
    """head, centre: the set that a bucket's head shares most with, and so on, four steps on."""
    up = first.select(F.col("a").alias("head"), F.col("b").alias("centre"))
    for _ in range(2):  # a head is greater than its own, so there is no circle
        over = up.select(F.col("head").alias("centre"), F.col("centre").alias("next"))
        up = up.join(over, "centre", "left").select("head", F.coalesce("next", "centre").alias("centre"))
    return settle(up, "jj-up")


def _by_difference(members: DataFrame, keyed: DataFrame, words: int, percent: int) -> DataFrame:
    """The links (a, b) between the roots of members (c, doc, root) that share a centre c.

    With D(x) = x minus c and c minus x, two members differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|
    shingles. Where their D are small enough to link without a common part, both are linked with
    the member whose D is smallest for its size; so those are tied to it. All other links need a
    common part of a known size, no larger than either D: D lists what a member has beyond the
    centre first, and such a pair meets in the front parts of its lists. Pairs within the group's
    main component aren't made. Groups of copies thus cost what their differences cost, not the
    square of their size.
    """
    near, far = 100 + percent, 100 - percent
    few = members.count() <= BROADCAST_IDS
    centres = settle(members.select("c").distinct(), "jj-centres")
    n_centres = centres.count()
    other = centres.join(keyed.select(F.col("doc_id").alias("c"), F.col("text").alias("middle")), "c")
    if few:
        other = keyed.select(F.col("doc_id").alias("c"), F.col("text").alias("middle")).join(F.broadcast(centres), "c", "left_semi")
    other = settle(other, "jj-middles")
    small = 0 if (other.agg(F.sum(F.length("middle"))).first()[0] or 0) <= BROADCAST_TEXT else BROADCAST_IDS + 1

    def differences(rows: DataFrame, whole: bool) -> DataFrame:
        """c, doc, root, n, the sizes k of D and beyond of its first part, and D, or what of it a partner can meet."""

        def run(batches):
            shingle, middles = Shingler(words), {}
            for batch in batches:
                out = []
                for c, doc, root, text, centre in _pairs_of([batch]):
                    if centre not in middles:
                        if len(middles) >= KEPT_CENTRES:
                            middles.clear()
                        middles[centre] = shingle(centre)
                    items, middle = shingle(text), middles[centre]
                    beyond, lacking = (np.setdiff1d(x, y, assume_unique=True) for x, y in ((items, middle), (middle, items)))
                    d = np.concatenate([beyond, lacking]).view(np.int64)
                    # A partner differs in no more than this, so its common part reaches into the front of D.
                    front = len(d) if whole else far * len(items) // percent + 2
                    out.append((c, doc, root, len(items), len(d), len(beyond), d[:front]))
                columns = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns[:6]], pa.array(columns[6], pa.list_(pa.int64()))], ["c", "doc", "root", "n", "k", "beyond", "d"])

        own = _beside(rows, keyed.select(F.col("doc_id").alias("doc"), "text"), "doc", few)
        both = join_hot(own, other, ["c"], small).select("c", "doc", "root", "text", "middle")
        return both.mapInArrow(lean(run), "c long, doc long, root long, n long, k long, beyond long, d array<long>")

    excess = near * F.col("k") - far * F.col("n")  # two of them: at most 0 where any two such sets link
    differ = settle(differences(members, False).withColumn("e", excess), "jj-differ")
    least = differ.groupBy("c").agg(F.min_by(F.struct("doc", "e", "root"), F.struct("e", "doc")).alias("x"))
    tied = join_hot(differ, least, ["c"], n_centres).where((F.col("e") + F.col("x.e") <= 0) & (F.col("root") != F.col("x.root")))
    tied = settle(tied.select(F.col("doc").alias("a"), F.col("x.doc").alias("b"), "root", F.col("x.root").alias("root_b")), "jj-tied")
    again = components(tied.select(F.col("root").alias("a"), F.col("root_b").alias("b")))
    now = again.select(F.col("node").alias("root"), F.col("root").alias("now"))
    renew = lambda rows: join_hot(rows, now, ["root"], again.count(), "left").withColumn("root", F.coalesce("now", "root")).drop("now")

    need = lambda e: F.greatest(F.lit(1), F.ceil(e))
    with_level = lambda level: need((F.col("e") + near * level) / (2 * near))

    def levelled(parts: DataFrame) -> DataFrame:
        """``parts`` of several components: their group's main one, own level, levels of partners at most as high."""
        parts = parts.withColumn("own", F.floor(F.col("e") / near)).where("k > 0")
        groups = parts.groupBy("c", "root").agg(F.count("*").alias("m")).groupBy("c").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("m", "root")).alias("main")).where("roots > 1")
        levels = parts.groupBy("c", "own").agg(F.max("k").alias("most")).groupBy("c").agg(F.collect_list(F.struct(F.col("own").alias("level"), "most")).alias("levels"))
        groups = groups.join(levels, "c").select("c", "main", "levels")  # no more levels than a document has shingles
        # A partner of a level has as much in common as it can share at most, no more.
        open_to = F.filter("levels", lambda v: (v["level"] <= F.col("own")) & (with_level(v["level"]) <= F.least("k", v["most"])))
        out = join_hot(parts, groups, ["c"], n_centres).withColumn("levels", F.transform(open_to, lambda v: v["level"]))
        return out.withColumn("main", F.col("root") == F.col("main")).where(F.size("levels") > 0)

    # What of the fronts is met in several components leaves few members: the others have no partner.
    front = (F.col("k") - with_level(F.array_min("levels")) + 1).cast("int")
    met = settle(levelled(renew(differ)).select("c", "doc", "root", F.posexplode(F.slice("d", F.lit(1), front)).alias("at", "item")), "jj-front")
    several = lambda rows: rows.groupBy("c", "item").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("f")).where("low < high").select("c", "item", "f")
    common = settle(several(met), "jj-common")
    met_again = settle(met.join(common.select("c", "item"), ["c", "item"]), "jj-met")
    alive = settle(met_again.select("c", "doc", "root").distinct(), "jj-alive")
    # Groups whose members would meet more often than they have differences: D is counted whole there.
    sizes = alive.join(differ.select("c", "doc", "k"), ["c", "doc"]).groupBy("c").agg(F.sum("k").alias("differences"))
    meetings = common.groupBy("c").agg(F.sum(F.col("f") * F.col("f")).alias("meetings")).join(sizes, "c")
    dense = settle(meetings.where("meetings > differences").select("c"), "jj-dense")
    n_dense = dense.count()

    # There all that is shared between components counts; D keeps its order without the rest.
    whole = settle(differences(join_hot(alive, dense, ["c"], n_dense, "left_semi"), True).withColumn("e", excess), "jj-whole")
    items = whole.select("c", "doc", "root", "e", "beyond", F.posexplode("d").alias("at", "item"))
    items = items.join(several(items).select("c", "item"), ["c", "item"])
    of = Window.partitionBy("c", "doc")
    items = items.select("c", "doc", "root", "e", "item", F.row_number().over(of.orderBy("at")).alias("at"), F.count("*").over(of).alias("k"), F.sum((F.col("at") < F.col("beyond")).cast("long")).over(of).alias("first"))
    rest = join_hot(met_again, dense, ["c"], n_dense, "left_anti").join(differ.select("c", "doc", "e", "k", F.col("beyond").alias("first")), ["c", "doc"])
    items = settle(items.unionByName(rest.withColumn("at", F.col("at") + 1)), "jj-items")
    parts = items.select("c", "doc", "root", "e", "k", "first").dropDuplicates(["c", "doc"])
    parts = settle(levelled(parts), "jj-parts")
    shared = items.select("c", "doc", "item", "at").join(parts, ["c", "doc"])
    # Of two members one at least is outside the main component: its own members meet only others.
    sides = F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    index = items.join(parts.select("c", "doc", "own", "main"), ["c", "doc"]).where(F.col("at") <= F.col("k") - need(F.col("e") / near) + 1)
    index = index.select("c", "item", F.col("own").alias("level"), F.explode(sides).alias("side"), F.col("doc").alias("b"), *[F.col(x).alias(f"{x}_b") for x in ("root", "e", "k", "first", "main")])
    probe = shared.select("c", "item", "at", "e", "k", "first", "own", "root", F.col("main").alias("side"), F.col("doc").alias("a"), F.explode("levels").alias("level"))
    probe = probe.where((F.col("at") <= F.col("k") - with_level(F.col("level")) + 1) & (~F.col("side") | (F.col("level") < F.col("own"))))
    most = F.least("first", "first_b") + F.least(F.col("k") - F.col("first"), F.col("k_b") - F.col("first_b"))
    meet = (F.col("root") != F.col("root_b")) & (F.col("e") + F.col("e_b") <= 2 * near * most) & ((F.col("level") < F.col("own")) | F.col("main_b") | (F.col("a") < F.col("b")))
    pairs = probe.join(index, ["c", "item", "level", "side"]).where(meet).select("a", "b").distinct()
    pairs = settle(pairs, "jj-pairs")
    links = _linked(pairs, keyed, words, percent)
    out = settle(tied.select("a", "b").unionByName(links), "jj-links")
    discard(centres, other, differ, tied, again, met, common, met_again, alive, dense, whole, items, parts, pairs, links)
    return out


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    keyed = keyed_text(docs)
    sets = settle(_sets(keyed, words), "jj-sets")
    merged = _merged(sets)
    # A document signs unless all its texts are copies of another's.
    copies = merged.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("rep") == F.col("doc_id")).alias("own")).where("not coalesce(own, false)")
    copies = settle(copies.select("doc_id"), "jj-silent")
    few = copies.count() <= BROADCAST_IDS
    keyed = keyed.where("doc_id is not null").join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")
    allocation = _allocation(keyed, merged.count(), words, percent)
    buckets = _buckets(_signatures(keyed, allocation, words, percent, chunk))

    # A set against the head of the bucket it shares most signatures with, then the other heads.
    shared = buckets.where("doc != head").groupBy(F.col("doc").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("n"))
    shared = settle(shared, "jj-shared")
    first = settle(shared.groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), "b")).alias("b")), "jj-first")
    links = _linked(first, keyed, words, percent)
    roots = components(links)
    rest = apart(shared.select("a", "b").join(first, ["a", "b"], "left_anti"), roots, roots.count())
    rest = settle(rest.select("a", "b"), "jj-rest")
    more = _linked(rest, keyed, words, percent)
    early, roots = roots, extended(roots, more)
    discard(early, rest)

    # What shares a bucket and is still in different components.
    tagged = join_hot(buckets, roots.withColumnRenamed("node", "doc"), ["doc"], roots.count(), "left").select("sig", "head", "doc", F.coalesce("root", "doc").alias("root"))
    mixed = tagged.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("head").alias("head")).where("low < high").select("sig", "head")
    centre = _centres(first)
    mixed = settle(mixed.join(centre, "head", "left").select("sig", F.coalesce("centre", "head").alias("c")), "jj-mixed")
    left = settle(join_hot(tagged, mixed, ["sig"], mixed.count()).select("c", "doc", "root").distinct(), "jj-left")
    tied = _by_difference(left, keyed, words, percent)
    last = extended(roots, tied)
    discard(shared, first, buckets, centre, mixed, left, links, more, tied, roots, sets, copies)

    # A rep is the least document of its set, so the root is the least of the component.
    out = join_hot(merged, last.withColumnRenamed("node", "rep"), ["rep"], last.count(), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def one_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of linked ones, with all its columns.

    Rows that share a doc_id are judged by their texts, each as a document of its own; of equal ones one row stays.
    Rows without a doc_id all stay.
    """
    near = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    twice = settle(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "jj-twice")
    shared = near(twice.withColumn("_shared", F.lit(True)))
    # Another number stands for such a row's id and text; it is below zero, where few ids are.
    own = F.when(F.col("_shared"), F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(2**63)))).otherwise(F.col("doc_id"))
    rows = docs.join(shared, "doc_id", "left").withColumn("_node", own)
    named = settle(join(rows.select(F.col("_node").alias("doc_id"), "text"), words, percent), "jj-named")
    gone = settle(named.where("component_id != doc_id").select(F.col("doc_id").alias("_node")).distinct(), "jj-gone")
    left = rows.join(near(gone), "_node", "left_anti")
    once = left.where("_shared is null").select(*docs.columns)
    again = left.where("_shared").select("_node", F.struct(*docs.columns).alias("_row"))
    again = again.groupBy("_node").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return once.unionByName(again.select("_row.*").select(*docs.columns))
