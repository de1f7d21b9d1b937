"""Column functions on text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def tokenize(text: Column) -> Column:
    """Lower-cased tokens without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*fixed.STOP_WORDS))


def sanitize_query(text: Column) -> Column:
    kept = F.regexp_replace(text, r"[^\w\s.@/\-+#]", "")
    return F.lower(F.trim(F.regexp_replace(kept, r"\s+", " ")))


#: fixed.EMAIL without recursion and starting only where a run of its first characters does: the same spans in linear time.
_LOCAL = "[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@" + fixed.EMAIL.split("@", 1)[1] + "+"


def redact(text: Column, label: str = "[REDACTED]") -> Column:
    """Cards, then e-mails, then phones: each pattern sees what those before have left."""
    for pattern in (fixed.CARD, _EMAIL, fixed.PHONE):
        text = F.regexp_replace(text, pattern, label)
    return text


def has_personal_data(text: Column) -> Column:
    """One character before the sign is enough to tell that there is an address."""
    return text.rlike(fixed.ANY_PERSONAL.replace(f"{_LOCAL}+@", f"{_LOCAL}@"))


def normalize_name(name: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), r"[^\w\s]", " "), r"\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*fixed.NAME_SUFFIXES)), " ")


def word_bag(normalized: Column) -> Column:
    """Sorted distinct words of a normalised name."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(normalized, " "))), " ")


def long_words(normalized: Column, least: int = 4) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: F.length(w) >= least))


def truncate(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, fixed.ANSI, "")


def scratchpad_to_think(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<REASONING_SCRATCHPAD>"), F.lit("<think>")), F.lit("</REASONING_SCRATCHPAD>"), F.lit("</think>"))


def is_silence(text: Column) -> Column:
    flat = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return (F.length(F.trim(text)) <= 64) & flat.isin(*fixed.SILENCE_MARKERS)


#: What stands between two key words of a threat: any words.
_FILLER = r"\s+(?:\w+\s+)*"


#: Between two key words: white space, anything on one line, white space. White space but a line break.
_GAP, _BLANK = r"\s+.*\s+", r"[^\S\n]"


def _gapped(*keys: str) -> list[str]:
    """Key words with gaps between them: of all places of a key on a line only the first, or the one that ends the line, can matter.

    From a key the next one is later on its line or first on the next line with words; from a key that ends its line it
    is anywhere on the next such line, or first on the one after that. Each choice is atomic, so nothing is tried twice.
    """
    gaps = ""
    for n, key in enumerate(keys[1:], 2):
        last = n == len(keys)
        goes_on, ends = ("", None) if last else (r"(?=\s)", rf"(?={_BLANK}*\n)")
        on_line = [rf"(?>[^\n]*?{_BLANK}{key}{goes_on})"] + ([rf"[^\n]*{_BLANK}{key}{ends}"] if ends else [])
        later = rf"[^\n]*+(?>\s+){key}{goes_on}"
        after_end = "|".join([*on_line, later])
        here = "|".join([rf"{_BLANK}(?:{x})" for x in [*on_line, later]])
        gaps += rf"(?:{here}|(?={_BLANK}*\n)(?:(?>\s\s+){key}{goes_on}|(?>\s+)(?:{after_end})))"
    return [rf"(?m)^(?>[^\n]*?{keys[0]}(?={_BLANK})){gaps}", rf"{keys[0]}(?={_BLANK}*\n){gaps}"]


def linear(pattern: str) -> list[str]:
    """Java patterns of which one is found where ``pattern`` is, without recursion over filler words.

    Key words and filler are one run of word characters and white space, so it is enough to look
    from the start of a run for the first of each key word after the one before.
    """
    if _GAP in pattern:
        return _gapped(*pattern.split(_GAP))
    for gap in (r"\s+.*", r"\s+[^\n]*"):
        if gap in pattern:  # the first key of a line is as good as any other, but for one that ends it
            first, rest = pattern.split(gap, 1)
            ways = [rf"(?m)^(?>[^\n]*?{first}(?={_BLANK}))[^\n]*{rest}", rf"{first}(?={_BLANK}*\n)(?>\s+)[^\n]*{rest}"]
            # a key of two words may itself go over the end of a line
            return ways + [rf"{a}(?={_BLANK}*\n)(?>\s+){b}(?>\s+)[^\n]*{rest}" for a, b in (x.split(r"\s+") for x in first.strip("()").split("|") if r"\s+" in x)]
    if pattern.startswith(r"<!--[^>]*"):  # between two ends of tags the first beginning and the first word in it will do
        begin, word, end = pattern.split("[^>]*")
        return [rf"(?:\A|(?<=>))(?>[^>]*?{begin})(?>[^>]*?{word})[^>]*{end}"]
    if r"[\s\S]*?" in pattern:
        first, rest = pattern.split(r"[\s\S]*?", 1)
        return [rf"(?s)\A(?>.*?{first}).*?{rest}"]
    keys = pattern.split(_FILLER)
    if len(keys) == 1:
        return [pattern]
    apart = [k for k in keys if "'" in k and "|" in k]  # a key word that ends a run is looked for by itself
    if apart:
        return [x for way in apart[0].strip("()").split("|") for x in linear(pattern.replace(apart[0], f"(?:{way})"))]
    steps = [rf"(?>[\w\s]*?{'' if k == 0 else '(?<=' + chr(92) + 's)'}{key}\s)" for k, key in enumerate(keys[:-1])]
    return [r"(?<![\w\s])" + "".join(steps) + rf"[\w\s]*?(?<=\s){keys[-1]}"]


def threats(text: Column, scope: str = "strict", more: tuple[tuple[str, str, str], ...] = ()) -> Column:
    """Ids of the threats found, in their fixed order, then those of ``more``, then invisible characters."""
    scopes = {"all": ("all",), "context": ("all", "context"), "strict": ("all", "context", "strict")}[scope]
    named = [(name, pattern) for name, own, pattern in (*fixed.THREATS, *more) if own in scopes]

    def found(lower: Column) -> Column:
        out = []
        for name, pattern in named:
            held = F.lit(False)
            for way in linear(pattern):
                held = held | text.rlike(f"(?i){way}")
            if name in fixed.THREAT_GUARDS:
                near = F.lit(False)
                for word in fixed.THREAT_GUARDS[name]:
                    near = near | lower.contains(word)
                held = near & held
            out.append(F.when(held, F.lit(name)))
        out.append(F.when(text.rlike(f"[{fixed.INVISIBLE}]"), F.lit("invisible_unicode")))
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    # Lower case is made once a text, and every pattern has literals without which it isn't tried.
    return F.get(F.transform(F.array(F.lower(text)), found), F.lit(0))


def decay(hours: Column) -> Column:
    """Halves in 30 days; what lies ahead counts as new."""
    return F.when(hours <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -hours / 720.0))


def parse_date(text: Column) -> Column:
    formats = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "yyyy/MM/dd", "MM-dd-yyyy")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def snippet(text: Column, word: str) -> Column:
    return F.regexp_replace(text, f"(?i)({word})", ">>>$1<<<")
