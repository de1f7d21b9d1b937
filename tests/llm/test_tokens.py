"""Byte-level BPE against tiktoken, token counts against the libraries."""

import hashlib
import pickle
import random

import public_tokenizers
import pytest
import tiktoken

from sparkloom.llm import byte_bpe, token_counts

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ALPHABET = "aabbcdeE 1290 \n\t\r\x0b\x1c\x1f\x85\xa0 　'stréßñ好😀!?.-_́"


def fuzz(seed, n=800):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ["", "a" * 3000, " " * 500, "ab" * 2000, "\n \n  x", "don't <|endoftext|> we'll"]


def ids(code):
    return [int.from_bytes(code[k : k + 4], "little") for k in range(0, len(code), 4)]


def test_encoding_is_tiktokens():
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    codec, texts = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN), fuzz(1)
    coded = codec.encode(texts)
    assert [ids(c) for c in coded] == [library.encode_ordinary(t) for t in texts]
    assert [d.decode() for d in codec.decode(coded)] == texts


def test_merges_that_make_an_earlier_rank_possible():
    ranks = {bytes([b]): b + 40 for b in range(256)} | {b"ab": 300, b"aba": 10, b"bc": 301, b"abab": 5, b"cab": 11, b"abc": 12}
    library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(600)]
    coded = byte_bpe.MergeReplay(ranks).encode([w.encode() for w in words])
    assert [ids(c) for c in coded] == [library.encode_ordinary(w) for w in words]


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 20), (1000, 50)])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_spliced_counts_are_those_of_the_whole(name, chunk, overlap):
    path = public_tokenizers.path(name)
    library = token_counts.Library(path, open(path, "rb").read())
    text = " ".join(fuzz(3, 150)) + " " + "x" * 700 + " the end <|endoftext|> of it"
    assert token_counts.spliced_count(text, library.starts, chunk, overlap) == library.counts([text])[0]


def test_pieces_count_like_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = token_counts.Library(path, open(path, "rb").read())
    for text in fuzz(4):
        assert sum(library.counts(token_counts.PIECES.findall(text))) == library.counts([text])[0]


def test_round_trip_and_counts_in_spark(spark):
    texts = [None, "", *fuzz(5, 60), "word " * 20_000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    for row in byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect():
        text = texts[row.doc_id] or ""
        want = library.encode_ordinary(text)
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in byte_bpe.decode(encoded, path).collect()} == {k: t or "" for k, t in enumerate(texts)}
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = token_counts.Library(path, open(path, "rb").read()).counts([t or "" for t in texts])
    for row in token_counts.count_tokens(docs, path).collect():
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((texts[row.doc_id] or "").encode()), whole[row.doc_id], whole[row.doc_id] > 1024)


def test_a_codec_takes_pairs_made_before():
    """Tasks get the pairs of the vocabulary made, and don't make them anew."""
    replay, texts = pickle.loads(pickle.dumps(byte_bpe.MergeReplay(RANKS))), fuzz(2)
    codec = byte_bpe.Codec(replay, public_tokenizers.PATTERN)
    assert codec.replay is replay
    assert codec.encode(texts) == byte_bpe.Codec(RANKS, public_tokenizers.PATTERN).encode(texts)
