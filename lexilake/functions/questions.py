"""What a question is about: flags, the document that it asks for, and the layers of its intent, as expressions.

All are native: patterns over the question's text. Unicode composition (NFC) is not applied, since no built-in has it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.functions import intent as I
from lexilake.functions.text import composed

# Phrases that mark a kind of question, wherever they stand in it, in lower case.
PROCEDURAL = (
    "what do i do|what do we do|what should i do|what can i do|next steps|how do i|how do you|how should i|can i get reimbursed|get reimbursed|"
    "reimbursed for|what documents do i need|what documents must|what should i verify|write a letter|draft a letter|draft me|write me an|notify the|"
    "appeal|first 10 steps|first 5 steps|provide the first|encountered|discovered|ran into|uncovered|fire overnight|fire at the site|fire at site|"
    "what does the government need|what does the govt need|request for equitable|submit an rea|submit a rea|structure the serial letter|"
    "disagreement|do not agree|dispute"
)
FREQUENCY = (
    "how often|how frequently|when do i submit|when do i send|daily report|frequency of report|reporting frequency|schedule of report|"
    "when are reports due|how many times"
)
LIFECYCLE = (
    "commissioning|punchlist|punch list|punch-list|substantial completion|beneficial occupancy|final inspection|functional testing|"
    "performance testing|system testing|acceptance testing|operational testing|turnover|closeout|close-out|close out|warranty period|"
    "warranty inspection|as-built|as built|red-line|redline|attic stock|o&m manual|operations and maintenance manual|building automation|"
    "fire alarm testing|elevator testing|balancing|tab report"
)
CHECKLIST = "generate a checklist|create a checklist|prepare a checklist|draft a checklist|write a checklist|inspection checklist"
FORM = "generate a form|create a form|prepare a form|draft a form|write a form"
LETTER = (
    "write me a|draft me a|draft a |write a |generate a |generate me a |create a |prepare a |serial letter|write the ko|draft an rea|write an rea|"
    "request for equitable|rea for |rfi |write an rfi|draft an rfi|stop-work order|inspection report|phase inspection|also include|add clause|"
    "revise the letter|update the letter|amend the letter|include this clause"
)
PRODUCT = (
    "document generator|process guidance agent|why can't i access|access the process guidance|recommend a lawyer|recommend an attorney|"
    "recommend a government contracts attorney|find me a lawyer|find me an attorney|find an attorney|export to word|export to pdf|export to excel|"
    "export the response|save as word|save as pdf"
)
# Patterns, whatever the case.
AMENDMENT = r"\b(also include|add clause|amend|revise|update|include this clause)\b.*\b(letter|rea|rfi)\b"
COMPARISON = (
    r"\bvs\.?\b|versus\b|difference(?:s)?\s+between\b|compar(?:e|ison)\s+(?:of|between)\b|how\s+(?:does?|do)\s+.{2,40}\s+differ\b|"
    r"distinguish\s+between\b|instead\s+of\b|rather\s+than\b|choose\s+between\b|why\s+.{2,20}\s+and\s+not\b|when\s+to\s+use\b|better\s+to\s+use\b"
)
SCHEDULE = r"\b(schedule|delay|time\s+extension|liquidated\s+damages?)\b"
RISK = r"\b(risk|entitlement|compensable|excusable|concurrent|impact|mitigation)\b"
QUESTION = r"^(what|how|when|where|why|can|should|do i|do we|does the|did the|is there|are there|if\s+i\s|if\s+we\s)\b"
HOOK = (
    r"\b(contract|contractor|government|ko|far|dfars|em\s*385|clause|requirement|schedule|payment|invoice|award|modification|order|letter|report|"
    r"document|delay|cost|price|bond|subcontract|prime|specification|specifications|drawing|compensable|concurrent|vendor)\b"
)
# Hazards; all words of one must stand in the question.
HAZARDS = (
    "uxo", "unexploded ordnance", "fire at site", "fire overnight", "gas leak", "hazardous discovery", "immediate hazard",
    "asbestos discovery", "safety emergency", "collapse", "structural failure", "trench collapse",
)
# Words of the field, each with its regular plural.
KEYWORDS = (
    "acquisition", "award", "bid", "bidder", "bidding", "clause", "competition", "competitive", "compliance", "contracting", "contractor",
    "contract", "cost", "cost-reimbursement", "cost-plus", "debarment", "default", "delivery", "earnest", "evaluation", "federal", "grant",
    "guaranty", "indemnification", "invoice", "invoicing", "labor", "labour", "liquidated damages", "modification", "negotiation",
    "offeror", "option", "penalty", "performance bond", "procurement", "proposal", "provision", "purchase order", "regulation",
    "requirement", "rfp", "rfq", "rfi", "sealed bid", "section", "solicitation", "subcontract", "subcontractor", "surety", "suspension",
    "asbestos", "confined space", "construction", "fall protection", "hazardous", "lockout", "noise exposure", "ozone", "ppe", "radiation",
    "respiratory", "rigging", "safety", "scaffold", "silica", "trench", "8a", "dbe", "disadvantaged", "hubzone", "sba", "sdvosb",
    "small business", "set-aside", "set-asides", "veteran-owned", "vosb", "wosb", "appropriation", "authorization", "clin", "defense",
    "department", "executive order", "far part", "fiscal", "government", "part", "prime contractor", "program", "project", "standard",
    "subpart", "title", "buy american", "domestic preference", "country of origin", "trade agreements act", "rea",
    "request for equitable adjustment", "equitable adjustment", "change order", "change orders", "cpars", "past performance", "debrief",
    "debriefing", "daily rate", "field office overhead", "overhead", "certify", "certification", "rea certification", "novation",
    "novation agreement", "withhold", "withholding", "withholdings", "termination for default", "termination for convenience", "protest",
    "bid protest", "gao protest", "agency protest", "product substitution", "product variance", "substitution", "variance", "mobilization",
    "mobilisation", "post award", "post-award", "compensable delay", "concurrent delay", "excusable delay", "delay letter", "serial letter",
    "structure the serial letter", "ko letter", "differing site conditions", "differing site condition", "site conditions", "duct bank",
    "gas line", "oil tank", "unexploded ordnance", "uxo", "wildfire", "fire at site", "fire overnight", "stop-work", "qc checklist",
    "quality checklist", "qc plan", "qc program", "qcm", "quality control manager", "conduit", "masonry", "demolition", "inspection report",
    "phase inspection", "submittal", "submittals", "rfis", "hot work", "hot work permit", "redline", "redline drawing", "as-built",
    "as built", "superintendent", "drawing", "drawings", "update drawing", "limited rights", "government purpose rights",
    "unlimited rights", "data rights", "scope", "scope of work", "scope alignment", "dispute", "disputes", "appeal", "disagreement",
    "bonding", "payment bond", "contracting officer representative", "cor", "contracting officer", "daily report", "daily reports", "prime",
    "subcontractor payment", "paying", "siop", "ppi", "pre-purchase inspection", "pre purchase inspection", "insurance",
    "insurance requirements", "small business set-aside", "set aside", "off site storage", "off-site storage", "offsite storage",
    "stored materials", "materials stored offsite", "bill of materials", "insurance certificate", "bond certificate", "storage location",
)
HINT = r"\bbuy\s+american\b"


def keyword_pattern(keyword: str) -> str:
    """The keyword between word boundaries; its words of letters may have a regular plural."""
    return r"\b" + r"\s+".join(w + "(?:s|es)?" if w.isalpha() else w for w in keyword.split()) + r"\b"


def hazard_patterns() -> list[list[str]]:
    return [[rf"\b{w}(?:s|es)?\b" for w in x.split()] for x in HAZARDS]


def normalised_question(question: Column) -> Column:
    """Composed characters, white space of any script single and trimmed; a null is empty."""
    return F.trim(F.regexp_replace(composed(F.coalesce(question, F.lit(""))), r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def document_type(q: Column) -> Column:
    """letter, checklist, form or null: the document that a question asks for."""
    low = F.lower(q)
    return F.when(low.rlike(CHECKLIST), "checklist").when(low.rlike(FORM), "form").when(low.rlike(AMENDMENT) | low.rlike(LETTER), "letter")


def safety_critical(q: Column) -> Column:
    low, out = F.lower(q), F.lit(False)
    for words in hazard_patterns():
        here = F.lit(True)
        for w in words:
            here = here & low.rlike(w)
        out = out | here
    return out


def flags(q: Column) -> dict[str, Column]:
    """By name, the flags of a normalised question."""
    low = F.lower(q)
    return {
        "is_procedural": low.rlike(PROCEDURAL),
        "is_contract_co": low.rlike(FREQUENCY),
        "is_comparison": q.rlike("(?i)" + COMPARISON),
        "is_construction_lifecycle": low.rlike(LIFECYCLE),
        "is_schedule_risk": q.rlike("(?i)" + SCHEDULE) & q.rlike("(?i)" + RISK),
        "is_safety_critical": safety_critical(q),
    }


def matched_keywords(q: Column, keywords: Sequence[str] | None = None) -> Column:
    """The keywords that a question holds, in their order."""
    return F.array_compact(F.array(*(F.when(q.rlike("(?i)" + keyword_pattern(k)), k) for k in keywords or KEYWORDS)))


def classify(questions: DataFrame, column: str = "question", similarity: str | None = None, away: str | None = None, least: float = 0.82) -> DataFrame:
    """questions with intent, confidence, clause_reference, regulation, keywords, document_type and the flags appended.

    Layers, the first that fits: a clause reference (1.0); questions about the product (out of scope); a regulation's
    name (0.8); a keyword (0.6); a question's opening with a word of the field (0.55); where the columns similarity and
    away give the cosines with the centroids in and out of scope, the first above the second and `least` (the cosine);
    a hazard (0.55). Out of scope otherwise, with confidence 0. A null or blank question is out of scope without flags.
    """
    q, none = F.col("_q"), F.lit(None).cast("string")
    rows = questions.withColumn("_q", normalised_question(F.col(column)))
    rows = rows.withColumns({"_k": matched_keywords(q), "_i": I.intent(q), **flags(q), "document_type": document_type(q)})
    kind, words, safe = F.col("_i.intent"), F.size("_k") > 0, F.col("is_safety_critical")
    clause = F.regexp_replace(F.col("_i.clause"), "-+$", "")
    near = F.lit(False) if similarity is None else F.coalesce((F.col(similarity) > F.col(away)) & (F.col(similarity) > least), F.lit(False))
    product = F.lower(q).rlike(PRODUCT) & ~words & (kind == "out_of_scope")
    framed = q.rlike("(?i)" + QUESTION) & q.rlike("(?i)" + HOOK)
    layer = (
        F.when(q == "", "blank").when(kind == "clause_lookup", "clause").when(product, "product").when(kind == "regulation_search", "source")
        .when(words, "keyword").when(framed, "frame").when(near, "semantic").when(safe, "safety").otherwise("none")
    )
    rows = rows.withColumn("_layer", layer)
    at = F.col("_layer")
    sure = F.when(at == "clause", 1.0).when(at == "source", 0.8).when(at == "keyword", 0.6).when(at.isin("frame", "safety"), 0.55)
    if similarity is not None:
        sure = sure.when(at == "semantic", F.col(similarity).cast("double"))
    silent = at.isin("blank", "product")
    last = at.isin("safety", "none")
    hint = F.when(q.rlike("(?i)" + HINT), "FAR")
    return rows.withColumns(
        {
            "intent": F.when(at == "clause", "clause_lookup").when(at.isin("blank", "product", "none"), "out_of_scope").otherwise("regulation_search"),
            "confidence": sure.otherwise(0.0),
            "clause_reference": F.when(at == "clause", F.concat(F.col("_i.regulation"), F.lit(" "), clause)),
            "regulation": F.when(at.isin("clause", "source"), F.col("_i.regulation")).when(at.isin("keyword", "frame"), hint).otherwise(none),
            "keywords": F.when(at == "keyword", F.col("_k")).otherwise(F.array().cast("array<string>")),
            "document_type": F.when(~silent, F.col("document_type")),
            **{f: F.col(f) & ~(silent | last if f in ("is_procedural", "is_contract_co") else silent) for f in flags(q)},
        }
    ).drop("_q", "_k", "_i", "_layer")
