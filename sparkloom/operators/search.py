"""Full-text search: a query grammar, a positional inverted index, phrases as neighbouring positions, snippets.

A query is words, "phrases", prefix* and their combinations by AND, OR, NOT and parentheses. Words side by side must
all be there and bind tightest, then NOT, AND, OR. A query names a bounded number of terms; their postings are picked
from an index in the order of its terms and meet by row, so that what moves is the postings and never the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A token is a run of letters and digits, in lower case.
TOKEN = r"[\p{L}\p{N}]+"
_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Phrase:
    """Terms at neighbouring positions; the last may be the start of a word."""

    terms: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


def sanitised(query: str) -> str:
    """What a user typed as a query that can be parsed: unmatched quotes, odd characters and dangling operators go."""
    phrases: list[str] = []

    def keep(m: re.Match) -> str:
        phrases.append(m.group())
        return f" \0{len(phrases) - 1}\0 "

    text = re.sub(r'"[^"]*"\*?', keep, query.replace("\0", " ")).replace('"', " ")
    text = re.sub(r"(?<![^\W_])\*+|(?<=\*)\*+", " ", text)
    text = re.sub(r"[^\w\s*.\-\0]", " ", re.sub(r"\*", "* ", text))
    text = re.sub(r"(?<![\w*])(AND|OR|NOT)\*", r"\1", text)
    text = re.sub(r"(?<!\S)(\w+(?:[.\-]\w+)+)(\*?)(?!\S)", lambda m: f'"{m[1]}"{m[2]}', text)
    words = re.sub(r"[.\-]", " ", re.sub(r'"[^"]*"\*?', keep, text)).split()
    while words and words[-1] in ("AND", "OR", "NOT"):
        words.pop()
    while words and words[0] in ("AND", "OR", "NOT"):
        words.pop(0)
    kept = [w for k, w in enumerate(words) if not (w in ("AND", "OR", "NOT") and words[k - 1] in ("AND", "OR", "NOT"))]
    return re.sub(r"\0(\d+)\0", lambda m: phrases[int(m[1])], " ".join(kept))


def parsed(query: str):
    """The expression of a query, None if it holds no term. What can't be parsed is a ValueError."""
    items = [(m.lastgroup, m.group(m.lastgroup)) for m in re.finditer(r'"(?P<phrase>[^"]*)"|(?P<mark>[()*])|(?P<word>[^\s()"*]+)', query)]
    at = 0

    def peek(kind: str, *values: str) -> bool:
        return at < len(items) and items[at][0] == kind and (not values or items[at][1] in values)

    def chain(part, word: str, build):
        nonlocal at
        found = part()
        while peek("word", word):
            at += 1
            found = joined(found, part(), build)
        return found

    def joined(left, right, build):
        if left is None or right is None:  # a part without a term asks for nothing
            return left if right is None else (None if build is Without else right)
        return build(left, right)

    def primary():
        nonlocal at
        if peek("mark", "("):
            at += 1
            found = either()
            if not peek("mark", ")"):
                raise ValueError(f"a bracket isn't closed: {query!r}")
            at += 1
            return found
        if at == len(items) or peek("mark") or peek("word", "AND", "OR", "NOT"):
            raise ValueError(f"a term is missing: {query!r}")
        terms = tuple(_TOKEN.findall(items[at][1].lower()))
        at += 1
        prefix = peek("mark", "*")
        at += prefix
        return Phrase(terms, prefix) if terms else None

    def side_by_side():
        found = primary()
        while at < len(items) and not peek("mark", ")") and not peek("word", "AND", "OR", "NOT"):
            found = joined(found, primary(), Both)
        return found

    def without():
        return chain(side_by_side, "NOT", Without)

    def both():
        return chain(without, "AND", Both)

    def either():
        return chain(both, "OR", Either)

    if not items:
        return None
    found = either()
    if at < len(items):
        raise ValueError(f"a bracket wasn't opened: {query!r}")
    return found


def positions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """term, key and the positions of the term in each row's text."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))
    found = texts.select(key, F.posexplode(tokens).alias("at", "term"))
    return found.groupBy("term", key).agg(F.sort_array(F.collect_list("at")).alias("positions"))


def write_index(texts: DataFrame, key: str, text: str, path: str) -> None:
    """The index in the order of its terms, so that a query reads the row groups of its terms; a frequent term is dealt by rows."""
    positions(texts, key, text).repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(path)


def phrases_of(node) -> list[Phrase]:
    if node is None:
        return []
    return [node] if isinstance(node, Phrase) else [p for side in (node.left, node.right) for p in phrases_of(side)]


def moved_back(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by) if by else places


def sized(places: Column, size: int) -> Column:
    return F.transform(places, lambda x: F.struct(x.cast("int").alias("at"), F.lit(size).alias("size")))


def matches(index: DataFrame, query, key: str) -> DataFrame:
    """key and hits (position and number of tokens of each found phrase, in order) of the rows that a query finds."""
    node = parsed(query) if isinstance(query, str) else query
    leaves = list(dict.fromkeys(phrases_of(node)))
    slots = list(dict.fromkeys((t, p.prefix and k == len(p.terms) - 1) for p in leaves for k, t in enumerate(p.terms)))
    if not slots:
        return index.select(key, F.lit(None).cast("array<struct<at: int, size: int>>").alias("hits")).limit(0)
    test = lambda slot: F.col("term").startswith(slot[0]) if slot[1] else F.col("term") == slot[0]
    wanted = test(slots[0])
    for slot in slots[1:]:
        wanted = wanted | test(slot)
    found = index.where(wanted)
    by_row = found.groupBy(key).agg(*[F.array_distinct(F.flatten(F.collect_list(F.when(test(s), F.col("positions"))))).alias(f"_s{k}") for k, s in enumerate(slots)])
    places = {}
    for leaf in leaves:
        own = [(k, slots.index((t, leaf.prefix and k == len(leaf.terms) - 1))) for k, t in enumerate(leaf.terms)]
        begins = [moved_back(F.col(f"_s{s}"), k) for k, s in own]
        both = begins[0]
        for other in begins[1:]:
            both = F.array_intersect(both, other)
        places[leaf] = both

    def holds(n) -> Column:
        if isinstance(n, Phrase):
            return F.size(places[n]) > 0
        left, right = holds(n.left), holds(n.right)
        return left & right if isinstance(n, Both) else left | right if isinstance(n, Either) else left & ~right

    def shown(n) -> list[Phrase]:
        return [n] if isinstance(n, Phrase) else shown(n.left) + ([] if isinstance(n, Without) else shown(n.right))

    hits = [sized(places[p], len(p.terms)) for p in dict.fromkeys(shown(node))]
    return by_row.where(holds(node)).select(key, F.array_sort(F.array_distinct(F.concat(*hits))).alias("hits"))


def snippet(text: Column, hits: Column, most: int = 24) -> Column:
    """At most ``most`` tokens of a text from a little before its first hit, hits marked, cuts shown."""
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)
    first = F.greatest(F.lit(0), F.element_at(hits, 1)["at"] - most // 4)
    stop = F.least(F.size(words), first + most)
    inside = F.array_distinct(F.flatten(F.transform(F.filter(hits, lambda h: (h["at"] < stop) & (h["at"] + h["size"] > first)), lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))
    begins = F.transform(F.filter(hits, lambda h: h["at"] < stop), lambda h: h["at"])

    def piece(k: Column) -> Column:
        word = F.get(words, k)
        opened = F.array_contains(inside, k) & (~F.array_contains(inside, k - 1) | F.array_contains(begins, k) | (k == first))
        closed = F.array_contains(inside, k) & (~F.array_contains(inside, k + 1) | F.array_contains(begins, k + 1) | (k == stop - 1))
        lead = F.when((k == first) & (first > 0), "...").otherwise(F.get(gaps, k))
        return F.concat(lead, F.when(opened, ">>>").otherwise(""), word, F.when(closed, "<<<").otherwise(""))

    body = F.array_join(F.transform(F.sequence(first, stop - 1), piece), "")
    return F.concat(body, F.when(stop < F.size(words), "...").otherwise(F.get(gaps, stop)))


def search_messages(messages: DataFrame, sessions: DataFrame, index: DataFrame, query: str, sources=None, without_sources=None, roles=None, around: int = 200) -> DataFrame:
    """Messages that a query finds, with a snippet, their neighbours' beginnings and their session's facts.

    Filters come before the index is met; only the sessions of found messages are ordered for the neighbours.
    """
    of = sessions.select(F.col("id").alias("session_id"), "source", "model", F.col("started_at").alias("session_started"))
    of = of.where(F.col("source").isin(list(sources))) if sources else of
    of = of.where(~F.col("source").isin(list(without_sources))) if without_sources else of
    found = matches(index, sanitised(query), "id")
    rows = messages.select("id", "session_id", "turn", "role", "ts", "content")
    hits = rows.where(F.col("role").isin(list(roles))) if roles else rows
    hits = hits.join(of, "session_id").join(found, "id")
    near = rows.select("session_id", "turn", F.substring("content", 1, around).alias("near"))
    # The neighbours are those next in turn; turns of a session are numbered without gaps or not.
    order = hits.select("session_id").distinct()
    w = Window.partitionBy("session_id").orderBy("turn")
    placed = near.join(order, "session_id", "left_semi").select("session_id", "turn", F.lag("near").over(w).alias("before"), F.lead("near").over(w).alias("after"))
    out = hits.join(placed, ["session_id", "turn"])
    return out.select("id", "session_id", "role", "ts", snippet(F.col("content"), F.col("hits")).alias("snippet"), "before", "after", "source", "model", "session_started")
