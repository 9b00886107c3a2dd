"""Answer assessment: claims, citations, groundedness, quality and confidence, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexilake.functions import text as T

# The citation pattern (any case), the content word pattern and the words that carry no content.
CITATION = r"\b(FAR|DFARS|EM\s*385)\b\s*(?:Part\s+)?\d+(?:\.\d+)?(?:-\d+)?|\b\d{2}\.\d{3}(?:-\d+)?\b|\b252\.\d{3}-\d+\b|\[[^\]]+\]"
CONTENT_WORD = r"[a-z0-9][a-z0-9\-]{2,}"
STOP_WORDS = (
    "the and for with that this from are was were have has had not but you your about into while where when what which who how they "
    "them their its can may must shall should would could than then there here also such each any all only other under over between "
    "within through onto our out per via use using used being been more most"
).split()


def claims(text: Column) -> Column:
    """Sentences or lines of at least 30 characters and 6 words that are no headings (#)."""
    return F.filter(T.sentences(text, 30), lambda s: ~s.startswith("#") & (F.size(T.words(s)) >= 6))


def citation_coverage(text: Column) -> Column:
    """Share of the claims that hold a citation; 0.5 without any claim."""
    return coverage_of(claims(text))


def coverage_of(found: Column) -> Column:
    """citation_coverage of claims that are at hand."""
    cited = F.filter(found, lambda s: s.rlike("(?i)" + CITATION))
    return F.coalesce(F.try_divide(F.size(cited), F.size(found)), F.lit(0.5))


def content_words(text: Column) -> Column:
    """Distinct lower-cased words of three characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CONTENT_WORD), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def groundedness(answer: Column, sources: Column) -> Column:
    """Share of the answer's content words that its sources hold; 0 where either has none."""
    own = content_words(answer)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, content_words(sources))), F.size(own)), F.lit(0.0))


def answer_quality(documents: Column, average: Column, top: Column, grounded: Column, coverage: Column, relaxed: Column, clause: Column, in_scope: Column) -> Column:
    """struct<quality, confidence, low_confidence, show_banner> from the evidence and the answer's own scores."""
    evidence = F.greatest(average, 0.7 * top + 0.3 * average)
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    quality = clamp(0.45 * evidence + F.when(relaxed, 0.35 * grounded + 0.20 * coverage).otherwise(0.30 * grounded + 0.25 * coverage))
    confidence = clamp(0.45 * evidence + 0.25 * grounded + 0.20 * coverage + 0.10 * quality)
    low = (documents < F.when(clause, 1).otherwise(2)) | ((confidence < 0.30) & (average < 0.35))
    banner = (documents <= 0) | (in_scope & low & (confidence < 0.25))
    return F.struct(F.round(quality, 4).alias("quality"), F.round(confidence, 4).alias("confidence"), low.alias("low_confidence"), banner.alias("show_banner"))
