"""Information-theoretic sanitisation of personal data, by DataFrame functions only.

Base spans (e-mail, IP, card, phone) are the protected entities. Corpus co-occurrence says how
strongly a term reveals one: with N documents, c(t) of them holding term t, c(e) naming entity e
and c(t, e) doing both,

    disclosure(t, e) = PMI(t, e) / IC(e) = log(N c(t, e) / (c(t) c(e))) / log(N / c(e)),

which is 1 where t is found in documents that name e alone; an entity that all documents name
has no information content, and nothing discloses it. Terms found in ``min_support`` documents
of an entity or more whose disclosure reaches ``threshold`` become spans of kind ``term``
wherever they stand, in every document of the corpus. ``sanitise`` removes the base spans and
generalises the terms.

All counts are of whole documents; a repeated row counts each time. Pairs are made only of
entities and terms that exact bounds leave: c(t, e) is at most c(t) and c(e), so both must reach
``min_support``, and the disclosure with the lesser of them for c(t, e) must reach ``threshold``.

The patterns are those of the contract with possessive quantifiers and a look-behind at the
start of a run, which match the same spans in linear time and without recursion.

Defined cases: a null text counts as empty and has no spans; a null doc_id is kept; repeated
rows get the same spans each; an empty table gives an empty one; other columns are ignored by
``find`` and kept by ``sanitise``. Positions are code points, ends exclusive. A row is known by
its doc_id and a hash of its text, so results don't depend on how a scan is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, settle

KINDS = ("email", "ip", "card", "phone", "term")
#: Java patterns: the match of each base kind, and a cheap test that a text can hold one.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][ -]?){13}", "phone": "+"}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: Letters of the shortest term.
TERM_LETTERS = 4
MIN_SUPPORT, THRESHOLD = 3, 0.8
#: Spans of at most so many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 8_000_000
BLOCK = 256
SPAN = "array<struct<kind:int,start:long,end:long>>"


def prefix_sums(values: Column) -> Column:
    """Sums of the values before each place; in two levels, so that long arrays stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    run = lambda first, xs: F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    heads = run(F.lit(0).cast("long"), F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)))
    parts = F.zip_with(blocks, heads, lambda xs, head: F.when(xs.isNotNull(), F.slice(run(head, xs), F.lit(1), F.size(xs))).otherwise(F.array().cast("array<bigint>")))
    return F.flatten(parts)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits are padded on the left, where zeros change nothing, to a fixed width."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for k in range(20):
        d = F.substring(padded, k + 1, 1).cast("int")
        total = total + (F.when(d > 4, d * 2 - 9).otherwise(d * 2) if k % 2 == 0 else d)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(13, 19) & _luhn(F.when(n <= 19, _digits(value)).otherwise("1"))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _cut(text: Column, pattern: str, guard: Column) -> tuple[Column, Column]:
    none = F.array().cast("array<string>")
    return F.when(guard, F.split(text, pattern, -1)).otherwise(none), F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base``: kind, start, end and value of each span."""
    out = docs
    for kind, pattern in PATTERNS.items():
        guard = F.col(text).contains(GUARDS[kind]) if kind in ("email", "phone") else F.col(text).rlike(GUARDS[kind])
        pieces, found = _cut(F.col(text), pattern, guard)
        out = out.withColumns({f"_{kind}_p": pieces, f"_{kind}_f": found})
    for kind in PATTERNS:
        p, f = F.col(f"_{kind}_p"), F.col(f"_{kind}_f")
        steps = F.zip_with(F.slice(p, F.lit(1), F.size(f)), f, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        out = out.withColumn(f"_{kind}_s", F.when(F.size(f) > 0, prefix_sums(steps)).otherwise(F.array().cast("array<bigint>")))
    spans = [_of_kind(k, kind) for k, kind in enumerate(PATTERNS)]
    return out.withColumn("_base", F.concat(*spans)).drop(*[f"_{kind}_{x}" for kind in PATTERNS for x in "pfs"])


def _of_kind(k: int, kind: str) -> Column:
    p, f, s = F.col(f"_{kind}_p"), F.col(f"_{kind}_f"), F.col(f"_{kind}_s")

    def one(value, i):
        start = F.get(s, i) + F.length(F.get(p, i))
        return F.struct(F.lit(k).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    return F.filter(F.transform(f, one), lambda x: _valid(kind, x["value"]))


def _entities(base: Column) -> Column:
    """The distinct entities of a document."""
    digits = lambda x: F.when(x["kind"] == 0, F.lower(x["value"])).otherwise(_digits(x["value"]))
    return F.array_distinct(F.transform(base, lambda x: F.concat_ws(":", x["kind"], digits(x))))


def _words(text: str) -> Column:
    """The distinct terms of a document."""
    long = F.regexp_extract_all(text, F.lit(rf"\p{{L}}{{{TERM_LETTERS},}}"), F.lit(0))
    return F.array_distinct(F.transform(long, F.lower))


def _places(docs: DataFrame) -> DataFrame:
    """A row for each long word of each document: doc_id, hash, term, start, end."""
    word = rf"\p{{L}}{{{TERM_LETTERS},}}"
    rows = docs.select("doc_id", "_hash", F.regexp_extract_all("text", F.lit(word), F.lit(0)).alias("f"), F.split("text", word, -1).alias("p")).where(F.size("f") > 0)
    rows = rows.withColumn("steps", F.zip_with(F.slice("p", F.lit(1), F.size("f")), "f", lambda a, b: (F.length(a) + F.length(b)).cast("long")))
    rows = rows.withColumn("before", prefix_sums(F.col("steps")))
    # A word ends where its own step does.
    ends = F.zip_with("before", "steps", lambda a, b: a + b)
    words = rows.select("doc_id", "_hash", F.explode(F.zip_with("f", ends, lambda w, end: F.struct(F.lower(w).alias("term"), (end - F.length(w)).alias("start"), end.alias("end")))).alias("w"))
    return words.select("doc_id", "_hash", "w.term", "w.start", "w.end")


def _disclosure(n_docs: int, c_t: Column, c_e: Column, c_te: Column) -> Column:
    n = F.lit(float(max(n_docs, 1)))
    ic = F.log(n / c_e)
    pmi = F.log(n * c_te / (c_t * c_e))
    return F.when(ic > 0, pmi / ic).otherwise(0.0)


def _small(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` broadcast where few, to be shuffled else."""
    return F.broadcast(rows) if n * 64 <= BROADCAST_BYTES else rows


def disclosing_terms(docs: DataFrame, found: DataFrame, n_docs: int, min_support: int, threshold: float) -> DataFrame:
    """entity, term and disclosure of the pairs that exceed the threshold."""
    c_t, c_e, c_te = F.col("c_t"), F.col("c_e"), F.col("c_te")
    named = found.select(F.explode("_entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("c_e"))
    named = settle(named.where((c_e >= min_support) & (c_e < n_docs)), "pii-named")
    n_named, most = named.agg(F.count("*"), F.max("c_e")).first()
    # The bound grows with c(e): a term that the most frequent entity rules out is ruled out by all.
    words = docs.select(F.explode(_words("text")).alias("term")).groupBy("term").agg(F.count("*").alias("c_t"))
    possible = _disclosure(n_docs, c_t, F.lit(most or 1), F.least(c_t, F.lit(most or 1))) >= threshold
    terms = settle(words.where((c_t >= min_support) & possible & F.lit(n_named > 0)), "pii-candidates")
    n_terms = terms.count()
    seen = found.where(F.size("_entities") > 0).select(F.explode("_words").alias("term"), "_entities").join(_small(terms, n_terms), "term")
    pairs = seen.select("term", "c_t", F.explode("_entities").alias("entity")).join(_small(named, n_named), "entity")
    pairs = pairs.where(_disclosure(n_docs, c_t, c_e, F.least(c_t, c_e)) >= threshold)
    pairs = pairs.groupBy("entity", "term").agg(F.first("c_t").alias("c_t"), F.first("c_e").alias("c_e"), F.count("*").alias("c_te")).where(c_te >= min_support)
    return pairs.select("entity", "term", _disclosure(n_docs, c_t, c_e, c_te).alias("disclosure")).where(F.col("disclosure") >= threshold)


def _spans(docs: DataFrame, min_support: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows with _base, the term spans of a row by doc_id and _hash)."""
    keyed = keyed_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("_hash", F.xxhash64("text"))
    named = F.size("_base") > 0
    found = base_spans(keyed).withColumns({"_entities": _entities(F.col("_base")), "_words": F.when(named, _words("text")).otherwise(F.array().cast("array<string>"))})
    found = settle(found.drop("text"), "pii-base")
    flagged = settle(disclosing_terms(keyed, found, found.count(), min_support, threshold).select("term").distinct(), "pii-flagged")
    terms = _places(keyed).join(_small(flagged, flagged.count()), "term", "left_semi")
    terms = terms.groupBy("doc_id", "_hash").agg(F.array_sort(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "end"))).alias("_terms"))
    return found.drop("_entities", "_words"), settle(terms, "pii-terms")


def _with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with ``_all``: base spans and the terms that overlap none of them."""
    size = terms.agg(F.sum(F.size("_terms"))).first()[0] or 0
    right = terms.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "_terms")
    right = F.broadcast(right) if size * 64 <= BROADCAST_BYTES else right
    joined = rows.join(right, (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    bare = F.transform("_base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).cast(SPAN)
    free = F.filter(F.coalesce(F.col("_terms").cast(SPAN), F.array().cast(SPAN)), lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.withColumn("_all", F.concat(bare, free)).drop("_id", "_h", "_terms")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find(docs: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """Counts of the base spans, the digest of their places, and all spans."""
    found, terms = _spans(docs, min_support, threshold)
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")
    bare = F.transform("_base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return _with_terms(found, terms).select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)], F.sha2(_joined(bare), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"))


def sanitise(docs: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with base spans removed and disclosing terms generalised in ``text``."""
    columns = docs.columns
    _, terms = _spans(docs, min_support, threshold)
    rows = base_spans(docs.withColumns({"_text": F.coalesce("text", F.lit("")), "_hash": F.xxhash64(F.coalesce("text", F.lit("")))}), "_text")
    rows = _with_terms(rows, terms)
    ordered = F.array_sort(F.transform("_all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    rows = rows.withColumn("_all", ordered)
    # Overlapping spans are one: a span that starts within those before it only extends them.
    seed = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS])
    copy = lambda a, b: F.substring(F.col("_text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        return F.struct(F.when(fresh, F.concat(acc["out"], copy(acc["at"], x["start"]), F.get(labels, x["kind"]))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate("_all", seed, step, lambda acc: F.concat(acc["out"], copy(acc["at"], F.length("_text"))))
    return rows.withColumn("text", F.when(F.size("_all") > 0, done).otherwise(F.col("text"))).select(*columns)
