"""Questions sent down the path that fits them, their hits judged, and those that fail searched once more.

Each path is one search over all of its questions; a question is on one path alone, and only failed ones are searched
again, so work grows with the questions that need it. How a question is put otherwise (`further`) is up to the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.operators import context as C
from lexilake.operators import search as X
from lexilake.session import written

#: from questions(query_id, query, ...) to hits(query_id, id, rank, score)
Search = Callable[[DataFrame], DataFrame]

# How much a second search looks for, and what passes.
FURTHER_QUERIES, FURTHER_HITS, HEALED_MOST = 2, 3, 4
PASSING, SURE = 0.5, 0.35
BETWEEN = "\n\n---\n\n"


def path(intent: Column, clause_reference: Column) -> Column:
    """clause, regulation or open: how a question is searched."""
    return F.when((intent == "clause_lookup") & clause_reference.isNotNull(), "clause").when(intent == "regulation_search", "regulation").otherwise("open")


def clause_documents(lookup: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, position, id, method, score, content of lookup, a result of search.clause_lookup over index(id, source, text).

    A question's first five chunks make one document, each under its source; its id is the first one's. It stands first: clause_lookup at the lookup's
    confidence where the clause was found, clause_fallback at 0.5 else; then follow the fallback's chunks one by one, but
    for those whose text is that document's.
    """
    rows = lookup.join(index.select("id", "source", F.coalesce("text", F.lit("")).alias("text")), "id").where("rank <= 5")
    parts = F.array_sort(F.collect_list(F.struct("rank", "id", "source", "text", "confidence")))
    whole = rows.groupBy("query_id", "found").agg(parts.alias("p"))
    content = F.array_join(F.transform("p", lambda x: F.concat(F.lit("**Source: "), F.coalesce(x["source"], F.lit("Unknown")), F.lit("**\n\n"), x["text"])), BETWEEN)
    score = F.when(F.col("found"), F.col("p")[0]["confidence"].cast("double")).otherwise(0.5)
    method = F.when(F.col("found"), "clause_lookup").otherwise("clause_fallback")
    first = whole.select("query_id", "found", "p", F.lit(1).alias("position"), F.col("p")[0]["id"].alias("id"), method.alias("method"), score.alias("score"), content.alias("content"))
    other = F.filter("p", lambda x: x["text"] != F.col("content"))
    fuzzy = first.where(~F.col("found")).select("query_id", F.posexplode(other).alias("n", "x"))
    each = fuzzy.select("query_id", (F.col("n") + 2).alias("position"), "x.id", F.lit("hybrid").alias("method"), F.col("x.confidence").cast("double").alias("score"), F.col("x.text").alias("content"))
    return first.drop("found", "p").unionByName(each)


def dispatched(questions: DataFrame, index: DataFrame, search: Search, clauses: DataFrame | None = None) -> DataFrame:
    """query_id, path, position, id, method, score, content for classified questions(query_id, query, intent,
    clause_reference) over index(id, text).

    Clause questions are looked up by number among clauses(id, source, text), the index if not given, and searched where
    that finds nothing; questions on regulations are searched. Open ones have no row: they take a choice that is not made
    here. No question is searched on two paths, and one that nothing is found for has no row.
    """
    sent = written(questions.withColumn("path", path(F.col("intent"), F.col("clause_reference"))))
    by_number = sent.where("path = 'clause'").select("query_id", F.col("clause_reference").alias("query"))
    chunks = clauses if clauses is not None else index
    none = chunks.sparkSession.createDataFrame([], "query_id long, id long, rank int, rrf_score double")
    exact = written(X.clause_lookup(chunks, by_number, none))
    missed = by_number.select("query_id").join(exact.select("query_id").distinct(), "query_id", "left_anti")
    # one search for both kinds of questions that need it
    asked = sent.where("path = 'regulation'").select("query_id").unionByName(missed)
    hits = written(search(sent.join(asked, "query_id", "left_semi").drop("path")).select("query_id", "id", "rank", "score"))
    fallback = hits.join(missed, "query_id", "left_semi").where("rank <= 5").select("query_id", "id", "rank", F.lit(False).alias("found"), F.col("score").alias("confidence"))
    documents = clause_documents(exact.unionByName(fallback), chunks).withColumn("path", F.lit("clause"))
    found = hits.join(missed, "query_id", "left_anti").join(index.select("id", "text"), "id")
    direct = found.select("query_id", F.col("rank").alias("position"), "id", F.lit("hybrid").alias("method"), "score", F.col("text").alias("content"), F.lit("regulation").alias("path"))
    return documents.unionByName(direct).select("query_id", "path", "position", "id", "method", "score", "content")


def searched_twice(
    questions: DataFrame, hits: DataFrame, further: DataFrame, index: DataFrame, search: Search, queries: int = FURTHER_QUERIES, most: int = HEALED_MOST, threshold: float = PASSING
) -> DataFrame:
    """query_id, reason, origin (first or healed), position, id for questions(query_id, query, regulation) with
    hits(query_id, id, rank, score, regulation, content).

    Hits that fail the critique, and badly, get those of a second search of the question's further(query_id, expansion,
    query): the first `queries` of these, `most` hits over index(id, source, section, text). Hits of another regulation
    go first. Questions that pass are not searched again. One without any hit is judged as well, and has no row of its
    own if the second search finds none either.
    """
    hits = written(hits.select("query_id", "id", "rank", "score", "regulation", "content"))  # judged and kept: searched for once
    judged = C.critique(hits, questions.select("query_id", "query", "regulation"), threshold)
    of = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("score", "rank").alias("raw"))
    badly = T.should_heal(F.coalesce("n", F.lit(0)), F.col("reason") == "mismatch", F.coalesce("raw", F.lit(0.0)), F.col("score"), threshold)
    verdicts = written(judged.join(of, "query_id", "left").select("query_id", "reason", (~F.col("passed") & badly).alias("heal")))
    again = further.where((F.col("expansion") < queries) & (F.col("expansion") >= 0)).join(verdicts.where("heal").select("query_id"), "query_id", "left_semi")
    # a search knows one number a question
    key = (F.col("query_id") * queries + F.col("expansion")).alias("query_id")
    found = written(search(again.select(key, "query"))).select(F.floor(F.col("query_id") / queries).alias("query_id"), F.pmod("query_id", F.lit(queries)).alias("expansion"), "id", "rank")
    texts = index.select("id", "source", "section", F.col("text").alias("content"))
    more = X.healed(found.join(texts, "id"), queries, most).select("query_id", "id", "position")
    kept = hits.join(verdicts, "query_id").where(~(F.col("heal") & (F.col("reason") == "mismatch")))
    rows = kept.select("query_id", "reason", F.lit("first").alias("origin"), F.col("rank").alias("position"), "id")
    return rows.unionByName(more.join(verdicts, "query_id").select("query_id", "reason", F.lit("healed").alias("origin"), "position", "id"))


def quality_gate(confidence: Column, mode: Column, retries: Column, healed: Column, added: Column, threshold: float = SURE) -> tuple[Column, Column]:
    """(whether an answer is made again after a second search, what the run's record says of it), where a second search adds so many documents.

    Answers are made again once at most; not those that pass, refuse, ask back, or rest on a second search already.
    """
    sure = F.coalesce(confidence, F.lit(0.0))
    told = F.format_string("%.2f", sure)
    limit = f"{threshold}"
    tried, passes = F.coalesce(retries, F.lit(0)) > 0, sure >= threshold
    asks, done = F.coalesce(mode.isin("refusal", "clarify"), F.lit(False)), F.coalesce(healed, F.lit(False))
    note = (
        F.when(tried, "QualityGate: skip (already retried)")
        .when(passes, F.concat(F.lit("QualityGate: pass (confidence="), told, F.lit(f" >= {limit})")))
        .when(asks, F.concat(F.lit("QualityGate: skip (mode="), mode, F.lit(")")))
        .when(done, "QualityGate: skip (already healed at retrieval)")
        .otherwise(F.concat(F.lit("QualityGate: confidence="), told, F.lit(f" < {limit} → healing triggered, added "), F.coalesce(added, F.lit(0)).cast("string"), F.lit(" supplemental docs")))
    )
    return ~(tried | passes | asks | done), note
