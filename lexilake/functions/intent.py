"""What a question asks for, by its wording: a clause, a regulation, or neither."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of regulations and the shape of a clause number (any case).
SOURCES = r"48\s*CFR|FAR|DFARS|DFARSPGI|HSAR|DEAR|VAAR|NFS|HHSAR|AFARS|NMCARS|DLAD|OSHA|EM[\s\-]*385"
CLAUSE = rf"\b({SOURCES})[\s\-,]*(?:section|part|clause)?[\s\-,]*(\d+(?:[\.\-\(\/][\d\-A-Za-z\(\)\.\/]+)?)"
SOURCE = rf"\b({SOURCES})\b"


def regulation(name: Column) -> Column:
    """One spelling a regulation: upper case, single blanks, EM385 however it was written."""
    upper = F.regexp_replace(F.upper(F.trim(name)), r"\s+", " ")
    return F.when(upper.rlike(r"^EM[\s\-]*385$"), "EM385").otherwise(upper)


def intent(question: Column) -> Column:
    """struct<intent, confidence, regulation, clause>: a clause reference (1.0), a regulation's name (0.8), or out of scope."""
    q = F.coalesce(question, F.lit(""))
    clause, source = (F.regexp_extract(q, "(?i)" + p, i) for p, i in ((CLAUSE, 2), (SOURCE, 1)))
    first = regulation(F.regexp_extract(q, "(?i)" + CLAUSE, 1))
    value = lambda kind, sure, reg, ref: F.struct(F.lit(kind).alias("intent"), F.lit(sure).alias("confidence"), reg.alias("regulation"), ref.alias("clause"))
    none = F.lit(None).cast("string")
    return F.when(clause != "", value("clause_lookup", 1.0, first, clause)).when(source != "", value("regulation_search", 0.8, regulation(source), none)).otherwise(value("out_of_scope", 0.0, none, none))
