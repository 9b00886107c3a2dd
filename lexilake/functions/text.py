"""Text and score expressions: Column in, Column out. Those over arrays (filter, transform, aggregate) run interpreted."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CLAUSE = r"(FAR|DFARS)\s+(\d+\.\d+(?:-\d+)?)"


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


@F.pandas_udf(StringType())
def _form_c(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def composed(text: Column) -> Column:
    """The text in Unicode's normal form C; ASCII texts, which are in it, reach Python as nulls."""
    return F.coalesce(_form_c(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def estimated_tokens(text: Column) -> Column:
    """floor(1.3 * words)."""
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("long")


def quarter_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("long")


# The stop words of PostgreSQL's English text search.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def search_terms(text: Column, stem: Callable[[Column], Column] = lambda w: w) -> Column:
    """The distinct words (letters and digits, lower-cased) of a text without English stop words, sorted; `stem` maps each."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    kept = F.array_except(found, F.array(*map(F.lit, ENGLISH_STOP_WORDS)))
    return F.array_sort(F.array_distinct(F.transform(kept, stem)))


def normalised(text: Column) -> Column:
    """For duplicate detection: no-break spaces, dashes and line ends made plain, blanks collapsed, trimmed."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), " –—−", " ---"), "\r\n?", "\n")
    return F.trim(F.regexp_replace(plain, r"[ \t\n\f\x0B]+", " "))


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences of at least so many characters: cut after . ! ? before white space, and at line ends."""
    cut = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\n\r\f\x0B]+", "$1␞"), "\n", "␞"), "␞")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.char_length(s) >= least)


def sentence_aligned_end(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t == "") | F.right(t, F.lit(1)).isin(".", "!", "?", '"', "'")


def clause_references(text: Column) -> Column:
    """array<struct<type, clause>>: all FAR references, then all DFARS ones; repeats stay."""

    def of(kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"\b{kind}\s+(\d+\.\d+(?:-\d+)?)"), F.lit(1))
        return F.transform(found, lambda c: F.struct(F.lit(kind).alias("type"), c.alias("clause")))

    return F.concat(of("FAR"), of("DFARS"))


def passes_quality_gate(text: Column) -> Column:
    """At least 8 tokens, 35 % letters and digits of printable characters, 8 % distinct words."""
    t = F.coalesce(text, F.lit(""))
    kept = lambda p: F.char_length(t) - F.char_length(F.regexp_replace(t, p, ""))
    alnum, printable = kept("[A-Za-z0-9]+"), kept("[^ \\t\\n\\r\\f\\x0B]+")
    found = F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]{2,}"), F.lit(0))
    distinct = F.size(F.array_distinct(found)) >= 0.08 * F.size(found)
    return (estimated_tokens(t) >= 8) & (alnum >= 0.35 * printable) & (F.size(found) > 0) & distinct


# How the first line of an anchor begins (any case), and words that bind, references and numbered conditions.
ANCHOR = r"^\s*(?:FAR|DFARS)?\s*(?:52\.\d{3}-\d+|252\.\d{3}-\d+|\d{2,3}\.\d{3}(?:-\d+)?)\b"
MANUAL_ANCHOR = r"^\s*\d+-\d+\."
OBLIGATION = r"\b(shall|must|required|only\s+if)\b"
CROSS_REFERENCE = r"\b(see\s+paragraph\s+\([a-z0-9ivx]+\)|as\s+defined\s+in|FAR\s+\d+\.\d+(?:-\d+)?|DFARS\s+\d+\.\d+(?:-\d+)?)\b"
CONDITION_LINE = r"(?:^|\n)[ \t]*\((?:[a-z]|\d+|[ivx]+)\)[ \t]+\S"


def first_line(text: Column) -> Column:
    return F.split_part(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")), F.lit("\n"), F.lit(1))


def is_anchor(text: Column) -> Column:
    """Whether a chunk begins with the number of a clause or of a manual's section; such may stay small."""
    line = first_line(text)
    return line.rlike("(?i)" + ANCHOR) | line.rlike(MANUAL_ANCHOR)


def must_stay_whole(text: Column) -> Column:
    """Whether a section binds someone, refers elsewhere, or has two numbered conditions or more."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike("(?i)" + OBLIGATION) | t.rlike("(?i)" + CROSS_REFERENCE) | (F.regexp_count(t, F.lit("(?i)" + CONDITION_LINE)) >= 2)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def critique_score(raw: Column) -> Column:
    """One 0-1 scale for three: above 1 a tenth, up to 0.1 twentyfold but 1 at most, else as it is."""
    return F.when(raw > 1, raw / 10).when(raw <= 0.1, F.least(raw * 20, F.lit(1.0))).otherwise(raw)


def answer_score(raw: Column) -> Column:
    clamp = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.when(raw > 1, F.least(raw / 10, F.lit(1.0))).when((raw > 0) & (raw <= 0.05), clamp(raw * 50, 0.10, 1.0)).otherwise(clamp(raw, 0.0, 1.0))


def technical_score(duplicates: Column, tiny: Column, oversized: Column, missing: Column) -> Column:
    lost = F.least(duplicates * 100, F.lit(20.0)) + F.least(tiny * 200, F.lit(30.0)) + F.least(oversized * 500, F.lit(10.0)) + F.least(missing * 100, F.lit(10.0))
    return F.greatest(F.lit(0.0), 100 - lost)


def answer_mode(clarify: Column, intent: Column, documents: Column, confidence: Column) -> Column:
    return (
        F.when(clarify, "clarify")
        .when(intent == "out_of_scope", "copilot")
        .when((intent == "clause_lookup") & (documents > 0), "grounded")
        .when(documents == 0, "refusal")
        .when(confidence >= 0.45, "grounded")
        .otherwise("copilot")
    )


def should_heal(documents: Column, mismatch: Column, raw: Column, score: Column, threshold: float) -> Column:
    return (documents == 0) | mismatch | (documents < 3) | ((raw > 0) & (raw <= 0.05) & (score < threshold)) | (score < threshold - 0.05)
