"""Expressions over records of runs, logs, feedback and replies of services: Column in, Column out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexilake.functions import text as T

# Marks in the steps of a run, words that tell a question's category (in this order), the words of a letter,
# the phrase of an answer without evidence, and the name space of hashed user ids.
REFLECTED = ("Reflection: Low", "Self-healing: Added", "QualityGate:")
CATEGORIES = (
    ("letter_amendment", ("also include", "add clause", "include 52.", "include far")),
    ("letter_request", ("write ", "draft ", "serial letter", "rea", "rfi")),
    ("lifecycle", ("commissioning", "punchlist", "closeout", "substantial completion")),
    ("offsite_storage", ("off site", "off-site", "offsite", "stored materials")),
    ("product_ui", ("document generator",)),
    ("fact_heavy", ("gao", "shipyard", "puget sound")),
)
LETTER = ("subject:", "dear", "sincerely", "request for equitable adjustment", "serial letter")
FALLBACK = "The retrieved regulatory excerpts do not directly address this specific question"
CASE_CITATION = r"\b(FAR|DFARS|EM\s*385)\b\s*\d"
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in parts:
        test = test | text.contains(p)
    return test


def contains_any(text: Column, keywords: Column) -> Column:
    """Whether the text holds a keyword, in any case; true without keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(F.coalesce(keywords, F.array().cast("array<string>"))) == 0, True).otherwise(F.exists(keywords, lambda k: low.contains(F.lower(k))))


def _step(path: Column, mark: str) -> Column:
    return F.exists(path, lambda p: p.contains(mark))


def path_summary(path: Column) -> Column:
    """What a run came to by its steps; unknown where there are none."""
    return (
        F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) == 0, "unknown")
        .when(_step(path, "clause_lookup"), "clause_lookup")
        .when(_step(path, "Clarifier:"), "clarifier")
        .when(_step(path, "regulation_search"), "regulation_search")
        .otherwise("other")
    )


def path_intent(path: Column) -> Column:
    """The word after intent= in the first step that has one, else null."""
    named = F.filter(path, lambda p: p.rlike(r"intent=\s*\S"))
    return F.regexp_extract(F.get(named, F.lit(0)), r"intent=\s*(\S+)", 1)


def reflected(flag: Column, path: Column) -> Column:
    """The flag where it is known, else whether a step tells of reflection."""
    return F.coalesce(flag, F.exists(path, lambda p: any_of(p, REFLECTED)), F.lit(False))


def category(question: Column) -> Column:
    low = F.lower(F.coalesce(question, F.lit("")))
    out = F
    for name, parts in CATEGORIES:
        out = out.when(any_of(low, parts), name)
    return out.when(low.rlike(r"\bwhat\s+(is|are)\b"), "definition").otherwise("other")


def case_verdict(kind: Column, path: Column, mode: Column, documents: Column, answer: Column) -> Column:
    """PASS, WARN, FAIL or INFO of an answer, by the category of its question."""
    low, clarified = F.lower(F.coalesce(answer, F.lit(""))), path == "clarifier"
    way = F.lower(F.coalesce(mode, F.lit("")))
    official = low.contains("contracting officer") & ~any_of(low, ("commissioning", "punchlist"))
    return (
        F.when(kind == "definition", F.when(clarified, "FAIL").otherwise("PASS"))
        .when(kind == "offsite_storage", F.when(clarified | (way == "clarify"), "FAIL").when(documents <= 0, "WARN").otherwise("PASS"))
        .when(kind == "letter_amendment", F.when(low.contains("error") | clarified, "FAIL").when(any_of(low, LETTER), "PASS").otherwise("WARN"))
        .when(kind == "lifecycle", F.when(clarified, "FAIL").when(official, "WARN").otherwise("PASS"))
        .when(kind == "product_ui", F.when(clarified | way.isin("copilot", "clarify"), "PASS").otherwise("WARN"))
        .when(kind == "fact_heavy", F.when(F.size(T.words(low)) < 80, "WARN").otherwise("PASS"))
        .otherwise("INFO")
    )


def gate_reasons(answer: Column, citation: Column, keywords: Column, expected: Column, regulations: Column, seconds: Column, most: Column) -> Column:
    """Names of the checks that an answer fails, in a fixed order; empty where it passes."""
    said = F.trim(F.coalesce(answer, F.lit("")), F.lit(" \t\r\n"))
    checks = [
        ("empty_response", said == ""),
        ("fallback_response", said.contains(FALLBACK)),
        ("missing_citation_marker", citation & ~said.rlike("(?i)" + CASE_CITATION)),
        ("missing_expected_keywords", ~contains_any(said, keywords)),
        ("unexpected_regulation_type", (F.coalesce(expected, F.lit("")) != "") & ~F.coalesce(F.array_contains(regulations, expected), F.lit(False))),
        ("latency_exceeded", seconds > most),
    ]
    return F.filter(F.array(*(F.when(test, name) for name, test in checks)), lambda r: r.isNotNull())


def preview(text: Column, most: int, mark: str = "") -> Column:
    """The first characters of a text on one line; mark where it is longer."""
    return F.replace(F.concat(F.left(text, F.lit(most)), F.when(F.char_length(text) > most, mark).otherwise("")), F.lit("\n"), F.lit(" "))


def is_uuid(text: Column) -> Column:
    """32 hexadecimal digits once urn:, uuid:, braces at the ends and hyphens are gone."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""), "-", "")
    return bare.rlike("^[0-9A-Fa-f]{32}$")


def user_uuid(user: Column) -> Column:
    """The id itself where it is a UUID, else its version-5 UUID in the DNS name space; a new random one for null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(user.cast("string"), "UTF-8")))
    part = lambda start, n: F.substring(digest, start, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    hashed = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
    return F.when(user.isNull(), F.expr("uuid()")).when(is_uuid(user.cast("string")), user.cast("string")).otherwise(hashed)


def guard_verdict(payload: Column) -> Column:
    """struct<action, should_block, confidence, tier_used, reason> of a guard's JSON reply; numbers that don't parse are null."""
    read = F.from_json(payload, "action string, should_block string, blocked string, confidence string, tier_used string, reason string, explanation string")

    def verdict(p: Column) -> Column:
        truth = lambda name: F.coalesce(~F.lower(p[name]).isin("false", "0", "null", ""), F.lit(False))
        action = F.lower(F.coalesce(F.nullif(p["action"], F.lit("")), F.lit("allow")))
        return F.struct(
            action.alias("action"),
            (truth("should_block") | truth("blocked") | (action == "block")).alias("should_block"),
            p["confidence"].try_cast("double").alias("confidence"),
            p["tier_used"].try_cast("int").alias("tier_used"),
            F.coalesce(F.nullif(p["reason"], F.lit("")), p["explanation"]).alias("reason"),
        )

    return F.transform(F.array(read), verdict)[0]  # a lambda's argument is parsed once, a column's fields one by one


def reply_scores(reply: Column) -> Column:
    """array<struct<index, score>> of a scorer's JSON reply, under scores or else results; items without both numbers are left out."""
    none = F.array().cast("array<struct<index:int,score:double>>")

    def item(i: Column) -> Column:
        number = lambda name, kinds: F.schema_of_variant(F.try_variant_get(i, f"$.{name}", "variant")).rlike(f"^({kinds})")  # noqa: E731, strings are none
        index = F.when(number("index", "BIGINT"), F.try_variant_get(i, "$.index", "int"))
        score = F.when(number("score", "BIGINT|DECIMAL|DOUBLE"), F.try_variant_get(i, "$.score", "double"))
        return F.named_struct(F.lit("index"), index, F.lit("score"), score)  # an alias is lost beside an explode

    def found(read: Column) -> Column:
        under = lambda name: F.try_variant_get(read, f"$.{name}", "array<variant>")
        items = F.when(F.size(under("scores")) > 0, under("scores")).otherwise(under("results"))
        return F.coalesce(F.transform(items, item), none)

    return F.filter(F.transform(F.array(F.try_parse_json(reply)), found)[0], lambda i: i["index"].isNotNull() & i["score"].isNotNull())


def message_seconds(message: Column) -> Column:
    """Seconds such as 1.25s in a log message, else null."""
    return F.regexp_extract(message, r"(\d+\.\d+)s", 1).try_cast("double")


def row_numbers(text: Column) -> Column:
    """Distinct whole numbers of a comma-separated list, ascending; blank parts are left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: p.cast("long"))))


def query_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))), 256)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint32(bits) | x >> np.uint32(32 - bits)


@F.pandas_udf(LongType())
def term_hash(terms: pd.Series) -> pd.Series:
    """Signed 32-bit MurmurHash3 of the whole 4-byte blocks of a text (seed 0); bytes beyond them count by their number only."""
    data = [b"" if t is None else t.encode() for t in terms]
    size = np.fromiter(map(len, data), np.int64, len(data))
    blocks = size // 4
    words = np.frombuffer(b"".join(x[: len(x) // 4 * 4] for x in data), "<u4")
    words = _turned(words * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    order = np.argsort(-blocks, kind="stable")
    start = (np.cumsum(blocks) - blocks)[order]
    longer = np.searchsorted(-blocks[order], -np.arange(blocks.max(initial=0)))
    h = np.zeros(len(data), np.uint32)
    for i, n in enumerate(longer):
        h[:n] = _turned(h[:n] ^ words[start[:n] + i], 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= size[order].astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    out = np.empty(len(data), np.int64)
    out[order] = h.view(np.int32)
    return pd.Series(out, index=terms.index).where(terms.notna()).astype("Int64")
