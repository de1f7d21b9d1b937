"""The pipeline's stages on a small corpus against brute-force versions."""

import hashlib
import random
import re

import brute
import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def groups(rows):
    """Components of links at a Jaccard similarity of 0.8 over five-word shingles."""
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * (n := len(a & b)) >= 80 * (len(a) + len(b) - n):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rnd = random.Random(1)
    body = docs.where("doc_id = 3").first().text
    words = body.split(" ")
    for _ in range(3):
        words[rnd.randrange(len(words))] = "anderes"
    odd = [(1000, "12 34 ...", None, "s", 9), (1001, None, None, None, None), (1002, " ".join(words), "fr", "s", 1), (1003, body + "\n" + items[0][1], "fr", "s", 1), (1004, "Ecrire à jean.dupont@mail.example.com ou +33 1 23 45 67 89. " + body[::-1], "fr", "s", 1)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "decontamination", "pii", "byte_bpe"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [at]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "byte_bpe":
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(f"{tmp_path}/out-{name}")
        at = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen.append(at)
    rows = [{r.doc_id: r for r in s.collect()} for s in seen]
    assert set(rows[0]) - set(rows[1]) == {1000, 1001}
    root = groups([(k, r.text) for k, r in rows[1].items()])
    assert set(rows[2]) == {k for k in rows[1] if root[k] == k}
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    assert set(rows[2]) - set(rows[3]) == {k for k, r in rows[2].items() if any(plain(t) in plain(r.text) for _, t in items)}
    assert set(rows[4]) == set(rows[3]) and rows[4][1004].text.startswith("Ecrire à [EMAIL] ou [PHONE].")
    for k, r in rows[4].items():
        if not any(brute.pii(rows[3][k].text)[:4]):
            assert r.text == rows[3][k].text
        assert r.n_chars == len(r.text)
        assert rows[5][k].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select(F.col("doc_id")).collect()} == set(rows[5])
