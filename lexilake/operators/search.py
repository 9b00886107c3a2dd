"""The whole search: hybrid hits, their sections' anchors and the chunks that they refer to, within one token budget."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.operators import retrieval as R
from lexilake.session import written

TOKEN_LIMIT = 2400
# A clause reference in a question.
REFERENCE = r"(?i)(FAR|DFARS|EM\s*385)\s*([\d]+[.\-][\d\-]+)"


def reranked(hits: DataFrame, scores: DataFrame | None = None, most: int = 12) -> DataFrame:
    """hits(query_id, id, rank) in the order of scores(query_id, id, score); as they are without any.

    Only the first `most` hits are scored and stay; one without a score counts as 0, and ties keep their order.
    """
    if scores is None:
        return hits
    found = hits.where(F.col("rank") <= most).join(scores.select("query_id", "id", F.col("score").alias("rerank_score")), ["query_id", "id"], "left")
    return R.ranked(found.fillna(0.0, ["rerank_score"]).withColumnRenamed("rank", "_r"), most, F.desc("rerank_score"), F.col("_r")).drop("_r")


def within_budget(rows: DataFrame, budget: int = TOKEN_LIMIT) -> DataFrame:
    """query_id, id, kind, tokens, position: of rows(query_id, id, kind, rank, tokens), in order of kind and rank, those
    that still fit each query's budget; one that doesn't is passed over. Tasks read a query's rows as they come."""

    def fold(batches):
        query, used, n = None, 0, 0
        for b in batches:
            keep, place = [], []
            for i, (q, t) in enumerate(zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if query is None or query[0] != q:
                    query, used, n = (q,), 0, 0
                if used + t <= budget:
                    used, n = used + t, n + 1
                    keep.append(i)
                    place.append(n)
            out = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column(j) for j in (0, 1, 2, 4)] + [pa.array(place, pa.int32())], ["query_id", "id", "kind", "tokens", "position"])

    order = ["query_id", "kind", "rank", "id"]
    dealt = rows.select(F.col("query_id").cast("long"), F.col("id").cast("long"), F.col("kind").cast("int"), F.col("rank").cast("int"), F.col("tokens").cast("long"))
    return dealt.repartition("query_id").sortWithinPartitions(*order).mapInArrow(fold, "query_id long, id long, kind int, tokens long, position int")


def prioritised(primary: DataFrame, anchors: DataFrame, references: DataFrame) -> DataFrame:
    """query_id, id, kind (0, 1, 2), rank: the three lists, each id once a query, in the first list that has it. Rows
    without an id all stay."""
    lists = [x.select("query_id", "id", F.lit(kind).alias("kind"), "rank") for kind, x in enumerate((primary, anchors, references))]
    both = lists[0].unionByName(lists[1]).unionByName(lists[2])
    first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("kind", "rank"))
    return both.withColumn("_n", first).where((F.col("_n") == 1) | F.col("id").isNull()).drop("_n")


def context(primary: DataFrame, anchors: DataFrame, references: DataFrame, index: DataFrame, budget: int = TOKEN_LIMIT, of_references: int = 4) -> DataFrame:
    """query_id, id, kind, tokens, position: what a query's context holds of index(id, text): the hits, then anchors, then
    the first references."""
    rows = written(prioritised(primary, anchors, references.where(F.col("rank") <= of_references)))
    # only texts that a context may hold are counted
    sized = rows.join(index.select("id", "text"), "id").withColumn("tokens", T.estimated_tokens(F.col("text")))
    return within_budget(sized, budget)


def parsed_reference(question: Column) -> Column:
    """struct<source, clause> of a question's clause reference; null where it has none."""
    source = F.regexp_replace(F.upper(F.regexp_extract(question, REFERENCE, 1)), r"\s+", "")
    clause = F.regexp_extract(question, REFERENCE, 2)
    return F.when(clause != "", F.struct(source.alias("source"), clause.alias("clause")))


def numbers(index: DataFrame) -> DataFrame:
    """id, source, number, place: each number with a separator in the texts of index(id, source, text), as long as it is
    there (digits, points and hyphens after a digit), and the character that it begins at, from 1."""
    # each piece is what stands before a number, and it; so lengths add up to places without the text
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[^0-9]*+(?:[0-9][0-9.\-]*+)?"), F.lit(0))
    parts = F.transform(pieces, lambda p: F.struct(F.char_length(p).alias("n"), F.regexp_extract(p, r"[0-9][0-9.\-]*+$", 0).alias("number")))
    rows = index.where(F.col("text").rlike(r"[0-9][.\-][0-9\-]")).select("id", "source", "text", F.monotonically_increasing_id().alias("row")).select("id", "source", "row", F.posexplode(parts).alias("at", "p"))
    upto = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("id", "source", "p.number", (F.sum("p.n").over(upto) - F.char_length("p.number") + 1).alias("place"))
    return placed.where(F.col("number").rlike(r"[0-9][.\-][0-9\-]"))


def _clause_keys(number: Column) -> Column:
    """The digit, separator and next character of each separator in a number: one of them is its clause's first."""
    at = F.sequence(F.lit(1), F.char_length(number))
    keys = F.transform(at, lambda i: F.substr(number, i, F.lit(3)))
    return F.array_distinct(F.filter(keys, lambda k: k.rlike(r"^[0-9][.\-][0-9\-]$")))


def clause_places(index: DataFrame, references: DataFrame) -> DataFrame:
    """source, clause, id, at: the first place in each text of index(id, source, text) of each of
    references(source, clause), clauses being a number, a point or hyphen and what REFERENCE lets follow.

    A clause stands wherever it is part of a longer number, so distinct numbers and distinct clauses meet by source and
    the clause's first separator with its neighbours; texts are read once and only their numbers are shuffled.
    """
    found = written(numbers(index))  # read twice
    key = F.regexp_extract("clause", r"([0-9][.\-][0-9\-])", 1)
    asked = references.select("source", "clause").distinct().withColumn("key", key)
    known = found.select("source", "number").distinct().withColumn("key", F.explode(_clause_keys(F.col("number"))))
    held = known.join(asked, ["source", "key"]).where(F.contains("number", F.col("clause"))).select("source", "number", "clause")
    at = F.col("place") + F.expr("locate(clause, number)") - 1
    return found.join(held, ["source", "number"]).groupBy("source", "clause", "id").agg(F.min(at).alias("at"))


def clause_lookup(index: DataFrame, questions: DataFrame, fallback: DataFrame, most: int = 10) -> DataFrame:
    """query_id, id, rank, found, confidence for questions(query_id, query) over index(id, source, text).

    Chunks of the reference's source that hold its number, earliest match first (found, 1.0); for questions without such
    a chunk or without a reference the first five of fallback(query_id, id, rank, rrf_score), not found, at its score.
    """
    asked = questions.select("query_id", parsed_reference(F.col("query")).alias("r")).where("r is not null").select("query_id", "r.*")
    first = F.row_number().over(Window.partitionBy("source", "clause").orderBy("at", "id"))
    few = clause_places(index, asked).withColumn("rank", first).where(F.col("rank") <= most)
    direct = asked.join(few, ["source", "clause"]).select("query_id", "id", "rank")
    exact = direct.withColumns({"found": F.lit(True), "confidence": F.lit(1.0)})
    rest = fallback.where("rank <= 5").join(direct.select("query_id").distinct(), "query_id", "left_anti")
    return exact.select("query_id", "id", "rank", "found", "confidence").unionByName(rest.select("query_id", "id", "rank", F.lit(False).alias("found"), F.col("rrf_score").alias("confidence")))


def healed(results: DataFrame, queries: int = 2, most: int = 10) -> DataFrame:
    """Of results(query_id, expansion, rank, source, section, content), the hits of a question's further queries: the first
    `queries` of these, rows of one source, section and start of the content once, `most` rows in all, with position."""
    start = F.left(F.coalesce("content", F.lit("")), F.lit(160))
    rows = results.where(F.col("expansion") < queries)
    once = F.row_number().over(Window.partitionBy("query_id", "source", "section", start).orderBy("expansion", "rank"))
    first = rows.withColumn("_n", once).where("_n = 1").drop("_n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("expansion", "rank"))).where(F.col("position") <= most)


def formatted_context(rows: DataFrame, budget: int = 4000, most: int = 1200, tokens: Callable[[Column], Column] = T.quarter_tokens) -> DataFrame:
    """query_id, n, context: the prompt text of rows(query_id, rank, content, source, regulation, section, score), ranks unique.

    A document is its rank, its fields and the first `most` characters of its content. In order of rank those that fit
    the budget by `tokens` are taken; one that doesn't is passed over, and its number stays unused. Null fields show as
    Unknown, N/A or 0. A query of which nothing fits has no row.
    """
    content = F.coalesce("content", F.lit(""))
    cut = F.concat(F.left(content, F.lit(most)), F.when(F.char_length(content) > most, "...").otherwise(""))
    told = [F.coalesce(F.col(c).cast("string"), F.lit(other)) for c, other in (("source", "Unknown"), ("regulation", "Unknown"), ("section", "N/A"))]
    text = F.format_string("--- Document %d ---\nSource: %s\nRegulation: %s\nSection: %s\nScore: %.3f\n\nContent:\n%s\n\n", F.col("rank").cast("int"), *told, F.coalesce(F.col("score").cast("double"), F.lit(0.0)), cut)
    shown = rows.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("id"), text.alias("text"))
    fits = within_budget(shown.select("query_id", "id", F.lit(0).alias("kind"), F.col("id").alias("rank"), tokens(F.col("text")).alias("tokens")), budget)
    taken = fits.select("query_id", "id", "position").join(shown, ["query_id", "id"])
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))  # no more than the budget holds
    return taken.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("context"))
