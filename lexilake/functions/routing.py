"""Where a classified question goes next, given the turns before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilake.functions.answers import CITATION

# What names the product, a role, a definition, an amendment, a letter, an acronym (any case).
PRODUCT_SIGNALS = (
    "upload submittal", "upload submittals", "upload document", "upload documents", "upload the specifications",
    "upload specifications", "load submittal registry", "load the submittal registry", "export to word", "export to pdf",
    "export the response", "download the response", "download response", "log in", "login", "sign in", "sign-in", "sign up",
    "signup", "my account", "recommend an attorney", "recommend a lawyer", "government contracts attorney",
    "government contracts lawyer", "find an attorney", "find a lawyer",
)
ROLE = r"(?i)^\s*as\s+a\s+(project\s+manager|project\s+executive|qcm|quality\s+control\s+manager|superintendent)\b"
DEFINITION = r"(?i)^\s*what\s+(is|are)\s+.+\??\s*$"
AMENDS = r"(?i)\b(also include|add clause|amend|revise|update|include this clause|include\b.*\binto the letter|include\b.*\bin the letter|add\b.*\bto letter)\b"
OF_LETTER = r"(?i)\b(into|in|to)\s+the\s+(letter|rea|rfi|draft)\b"
LETTER_TEXT = r"(?i)\b(subject:|dear\s+\w+|sincerely|request for equitable adjustment|serial letter)\b"
ACRONYM = r"(?i)^\s*what\s+is\s+(?:a\s+|an\s+)?([A-Z]{2,8})\s*\??\s*$"


def with_history(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with prior_clause (the first citation of the latest assistant turn among the four
    before that has one) and after_letter (the assistant's turns among the three before read like a letter). Turns of one number stand by role and text."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = F.col("role") == "assistant"
    cited = F.when(own, F.nullif(F.regexp_extract("text", "(?i)" + CITATION, 0), F.lit("")))
    letters = F.array_join(F.collect_list(F.when(own, F.coalesce("text", F.lit("")))).over(before.rowsBetween(-3, -1)), " ")
    return turns.withColumn("_cited", cited).withColumns({"prior_clause": F.last("_cited", True).over(before.rowsBetween(-4, -1)), "after_letter": letters.rlike(LETTER_TEXT)}).drop("_cited")


def route(questions: DataFrame) -> DataFrame:
    """questions(question, intent, confidence, clause_reference, keywords, document_type, prior_clause, after_letter) with
    clause_reference and document_type brought up to date, and next, mode, acronym appended.

    Short, unsure follow-ups inherit the clause of the turns before. Questions about the product, and those of five words
    or fewer that say too little, go to the clarifier; amendments of a letter to retrieval; a bare acronym is asked back;
    what is out of scope and asks for no document ends. A null question is the empty one.
    """
    q = F.trim(F.regexp_replace(F.coalesce("question", F.lit("")), r"\s+", " "))
    n = F.when(q == "", 0).otherwise(F.size(F.split(q, " ")))
    regulation, own = F.col("intent") == "regulation_search", F.col("clause_reference")
    takes = regulation & (F.col("confidence") < 0.7) & own.isNull() & F.col("prior_clause").isNotNull() & (n < 12)
    clause = F.when(takes, F.col("prior_clause")).otherwise(own)
    product = F.lit(False)
    for sign in PRODUCT_SIGNALS:
        product = product | F.lower(q).contains(sign)
    vague = (n <= 5) & clause.isNull() & (F.size("keywords") <= 0) & ~q.rlike(DEFINITION)
    unclear = regulation & own.isNull() & ((product & ~q.rlike(ROLE)) | vague)
    amends = q.rlike(AMENDS) & (F.coalesce("after_letter", F.lit(False)) | q.rlike(OF_LETTER))
    acronym = F.when(regulation & own.isNull(), F.nullif(F.upper(F.regexp_extract(q, ACRONYM, 1)), F.lit("")))
    away = (F.col("intent") == "out_of_scope") & F.col("document_type").isNull()
    to = F.when(acronym.isNotNull(), "end").when(amends, "data_retrieval").when(unclear, "clarifier").when(away, "end").otherwise("data_retrieval")
    mode = F.when(acronym.isNotNull() | unclear, "clarify").when(away, "copilot")
    return questions.withColumns({"next": to, "mode": mode, "acronym": acronym, "clause_reference": clause, "document_type": F.when(amends, "letter").otherwise(F.col("document_type"))})
