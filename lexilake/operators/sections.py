"""Structure of regulation texts: a class for each line, and sections with the headings that hold for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a line of each class looks like; the first that fits counts.
FOOTER = r"^\d+$|(?i:FEDERAL ACQUISITION REGULATION)|EM\s+385"
REGULATION_LINES = [
    ("PART", r"(?i)^PART\s+\d+\b"),
    ("SUBPART", r"(?i)^Subpart\s+\d+\.\d+\b"),
    ("APPENDIX", r"(?i)^APPENDIX\s+[A-Z]\b"),
    ("APPENDIX_SECTION", r"^[A-Z]-\d+\b|(?i:^Rule\s+\d+\b)"),
    ("SECTION", r"^\d{2,3}\.\d{3}(?:-\d+)?(?:\([a-z]\)(?:\(\d+\))?)?\s+"),
]
MANUAL_LINES = [("CHAPTER", r"(?i)^Chapter\s+\d+\b"), ("SECTION", r"^(?:\d+-\d+\.|\d{2}\.[A-Z]\.\d{2})\s+")]


def line_class(line: Column, source: Column) -> Column:
    """EMPTY, FOOTER, PART, SUBPART, APPENDIX, APPENDIX_SECTION, SECTION, CHAPTER or BODY."""
    t = F.trim(line)
    out = F.when(t == "", "EMPTY").when(t.rlike(FOOTER), "FOOTER")
    for among, rules in ((["FAR", "DFARS"], REGULATION_LINES), (["EM385"], MANUAL_LINES)):
        for kind, pattern in rules:
            out = out.when(source.isin(*among) & t.rlike(pattern), kind)
    return out.otherwise("BODY")


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, source, pos, line, kind: a row for each line of documents(doc_id, source, text)."""
    each = documents.select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return each.withColumn("kind", line_class(F.col("line"), F.col("source")))


def sections(classified: DataFrame) -> DataFrame:
    """doc_id, section (from 1), heading, part, subpart, appendix, n_lines, text of the lines of each document.

    A section begins at a SECTION or APPENDIX_SECTION line; what stands before the first is dropped, and so are empty
    lines and footers. A part ends the subpart and appendix before it, an appendix ends part and subpart. One window
    over a document's lines carries all of it.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_kind = lambda *kinds: F.col("kind").isin(*kinds)
    last = lambda kind: F.last(F.when(is_kind(kind), F.struct("pos", F.trim("line").alias("title"))), ignorenulls=True).over(w)
    used = classified.where(~F.col("kind").isin("EMPTY", "FOOTER"))
    carried = used.select(
        "doc_id", "pos", "line", "kind", last("PART").alias("p"), last("SUBPART").alias("s"), last("APPENDIX").alias("a"),
        F.sum(is_kind("SECTION", "APPENDIX_SECTION").cast("int")).over(w).alias("section"),
    ).where("section > 0")
    after = lambda c, *others: F.when(F.col(f"{c}.pos") > F.greatest(F.lit(-1), *(F.coalesce(f"{o}.pos", F.lit(-1)) for o in others)), F.col(f"{c}.title"))
    body = carried.where(is_kind("SECTION", "APPENDIX_SECTION", "BODY"))
    first = lambda c: F.min_by(c, "pos")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return body.groupBy("doc_id", "section").agg(
        first(F.trim("line")).alias("heading"), first(after("p", "a")).alias("part"), first(after("s", "p", "a")).alias("subpart"),
        first(after("a", "p")).alias("appendix"), F.count(F.lit(1)).alias("n_lines"), text.alias("text"),
    )
