"""Queries of dispatch, second search, quality gate and small lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexilake.functions import contain as J
from lexilake.functions import questions as K
from lexilake.operators import chunking as H
from lexilake.operators import dispatch as D
from lexilake.operators import lookups as L
from lexilake.operators import reports as O
from lexilake.operators import retrieval as R
from lexilake.operators import search as X
from lexilake.operators import sections as G
from lexilake.plans.registry import _CLASSIFIED, _CRITIQUED, _HITS, _asked, _headed, _index, _pick, _picked, _texts, query
from lexilake.session import table, written

#: what stands before the benchmark texts, in turn
_STARTS = ("FAR 52.4 says ", "EM 385 1-9 on ", "the dfars says ", "how to bake a cake with ", "is the contractor ", "FAR 52.77 says ")
_REFERENCE = X.REFERENCE
_NUMBERED = "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'FAR' ELSE 'EM385' END AS source, text || ' 52.' || (doc_id % 9) || ' ' AS text FROM documents"


def _hybrid(spark, d):
    """Search by both legs: questions(query_id, query, vector) to hits."""

    def search(asked):
        fused = R.reciprocal_rank_fusion(R.dense_batch(_index(spark, d), asked), R.lexical_batch(_texts(spark, d), asked))
        return written(R.boosted(fused, 10).select("query_id", "id", "rank", F.col("rrf_score").alias("score")))  # few rows: texts come to them unshuffled

    return search


@query(
    _HITS + rf""", x AS (SELECT item_id AS query_id, trim(regexp_replace({_pick(_STARTS, 'item_id')} || text, '\s+', ' ', 'g'), ' ') AS q FROM benchmark JOIN embeddings ON item_id = vec_id), {_CLASSIFIED},
ix AS ({_NUMBERED}),
r AS (SELECT query_id, upper(regexp_replace(regexp_extract(clause_reference, '{_REFERENCE}', 1), '\s+', '', 'g')) AS source, regexp_extract(clause_reference, '{_REFERENCE}', 2) AS clause FROM classified WHERE intent = 'clause_lookup'),
m AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY strpos(lower(text), clause), id) AS rank FROM r JOIN ix USING (source) WHERE clause <> '' AND strpos(lower(text), clause) > 0 QUALIFY rank <= 10),
f AS (SELECT query_id, id, rank, true AS found, 1.0 AS confidence FROM m UNION ALL SELECT query_id, id, rank, false, rrf_score FROM h WHERE rank <= 5 AND query_id IN (SELECT query_id FROM r) AND query_id NOT IN (SELECT query_id FROM m)),
w AS (SELECT query_id, found, arg_min(id, rank) AS id, string_agg('**Source: ' || source || '**' || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS content FROM f JOIN ix USING (id) WHERE rank <= 5 GROUP BY 1, 2)
SELECT query_id, 'clause' AS path, CAST(1 AS INTEGER) AS position, id, CASE WHEN found THEN 'clause_lookup' ELSE 'clause_fallback' END AS method, CASE WHEN found THEN 1.0 ELSE 0.5 END AS score, md5(content) AS content FROM w
UNION ALL SELECT query_id, 'clause', CAST(rank + 1 AS INTEGER), f.id, 'hybrid', confidence, md5(coalesce(ix.text, '')) FROM f JOIN ix USING (id) JOIN w USING (query_id) WHERE NOT f.found AND coalesce(ix.text, '') <> w.content
UNION ALL SELECT query_id, 'regulation', CAST(rank AS INTEGER), id, 'hybrid', rrf_score, md5(text) FROM h JOIN documents ON doc_id = id WHERE query_id IN (SELECT query_id FROM classified WHERE intent = 'regulation_search')"""
)
def dispatched_documents(spark, d):
    """All benchmark texts, each searched on the path that its wording asks for."""
    asked = _asked(spark, d)
    said = K.classify(asked.withColumn("question", F.concat(_picked(_STARTS, "query_id"), F.col("query")))).select("query_id", "query", "vector", "intent", "clause_reference")
    clauses = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("if(doc_id % 2 = 0, 'FAR', 'EM385')").alias("source"), F.expr("text || ' 52.' || (doc_id % 9) || ' '").alias("text"))
    return D.dispatched(said, _texts(spark, d), _hybrid(spark, d), clauses).withColumn("content", F.md5("content"))


_EVERY_THIRD = "array_to_string(list_filter(string_split(text, ' '), lambda w, i: (i - 1) % 3 = e), ' ')"


_FUSED_HITS = ", fh AS (SELECT query_id, id, rank, rrf_score AS similarity FROM h)"
_JUDGED = _CRITIQUED.replace("h AS (SELECT dense.*, i.source, i.text FROM dense JOIN i USING (id))", "hs AS (SELECT fh.*, source, text FROM fh JOIN documents ON doc_id = id)").replace("FROM h JOIN a", "FROM hs h JOIN a")


@query(
    _HITS + _FUSED_HITS + _JUDGED.rstrip() + f""",
c AS (SELECT query_id, count(*) AS n, arg_min(similarity, rank) AS raw FROM fh GROUP BY 1),
v AS (SELECT query_id, reason, reason <> 'match' AND (coalesce(n, 0) = 0 OR reason = 'mismatch' OR n < 3 OR (raw > 0 AND raw <= 0.05 AND score < 0.5) OR score < CAST(0.5 AS DOUBLE) - CAST(0.05 AS DOUBLE)) AS heal FROM z LEFT JOIN c USING (query_id)),
ft AS (SELECT DISTINCT query_id, e, term FROM (SELECT item_id AS query_id, e, unnest(regexp_split_to_array(lower({_EVERY_THIRD}), '[^a-z0-9]+')) AS term FROM benchmark, range(2) t(e)) JOIN v USING (query_id) WHERE heal AND length(term) > 1),
fl AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, id) AS rank FROM (SELECT query_id, e, id, round(count(*) / (count(*) + 1), 6) AS score FROM post JOIN ft USING (term) GROUP BY ALL) QUALIFY rank <= 3),
fd AS (SELECT query_id, e, fl.id, rank FROM fl JOIN documents d ON d.doc_id = fl.id QUALIFY row_number() OVER (PARTITION BY query_id, d.source, left(coalesce(d.text, ''), 160) ORDER BY e, rank) = 1),
fp AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY e, rank) AS position FROM fd QUALIFY position <= 4)
SELECT query_id, reason, 'first' AS origin, CAST(rank AS INTEGER) AS position, id FROM fh JOIN v USING (query_id) WHERE NOT (heal AND reason = 'mismatch')
UNION ALL SELECT query_id, reason, 'healed', CAST(position AS INTEGER), id FROM fp JOIN v USING (query_id)"""
)
def healed_search(spark, d):
    """Fused hits of all benchmark texts; the failing ones get lexical hits of every third word, from the first and second on."""
    index, asked = _index(spark, d), _asked(spark, d)
    texts = _texts(spark, d).withColumn("section", F.lit(None).cast("string"))
    hits = _hybrid(spark, d)(asked).join(texts.select("id", F.col("source").alias("regulation"), F.col("text").alias("content")), "id")
    questions = asked.join(index.select(F.col("id").alias("query_id"), F.col("source").alias("regulation")), "query_id")
    third = F.filter(F.split("query", " "), lambda w, i: i % 3 == F.col("expansion"))
    further = asked.select("query_id", "query", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("expansion")).select("query_id", "expansion", F.array_join(third, " ").alias("query"))
    return D.searched_twice(questions, hits, further, texts, lambda q: R.lexical_batch(_texts(spark, d), q, D.FURTHER_HITS))


@query(
    """WITH x AS (SELECT event_id, CAST(floor(value) AS BIGINT) % 100 / CAST(100 AS DOUBLE) AS sure, CASE event_type WHEN 'view' THEN 'clarify' WHEN 'click' THEN 'grounded' ELSE 'copilot' END AS mode, user_id % 7 = 0 AS tried, event_id % 5 = 0 AS done, event_id % 4 AS added FROM events)
SELECT event_id, NOT tried AND sure < 0.35 AND mode <> 'clarify' AND NOT done AS heals, CASE WHEN tried THEN 'QualityGate: skip (already retried)' WHEN sure >= 0.35 THEN 'QualityGate: pass (confidence=' || printf('%.2f', sure) || ' >= 0.35)'
  WHEN mode = 'clarify' THEN 'QualityGate: skip (mode=clarify)' WHEN done THEN 'QualityGate: skip (already healed at retrieval)' ELSE 'QualityGate: confidence=' || printf('%.2f', sure) || ' < 0.35 → healing triggered, added ' || added || ' supplemental docs' END AS note FROM x WHERE sure IS NOT NULL"""
)
def quality_gates(spark, d):
    mode = F.when(F.col("event_type") == "view", "clarify").when(F.col("event_type") == "click", "grounded").otherwise("copilot")
    sure = F.floor("value") % 100 / F.lit(100.0)
    heals, note = D.quality_gate(sure, mode, (F.col("user_id") % 7 == 0).cast("int"), F.col("event_id") % 5 == 0, F.col("event_id") % 4)
    return table(spark, d, "events").where("value is not null").select("event_id", heals.alias("heals"), note.alias("note"))


_LOG = """SELECT ts AS created_at, user_id % 3 = 0 AS was_cached, CASE event_type WHEN 'view' THEN 'regulation_search' WHEN 'click' THEN 'clause_lookup' WHEN 'error' THEN 'out_of_scope' END AS intent, event_id % 6 = 0 AS reflection_triggered,
  value < 5 AS low_confidence, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count, least(value / 100, 1.0) AS quality_score, CAST(user_id % 10 AS DOUBLE) / 10 AS citation_coverage, CAST(event_id % 9 AS DOUBLE) / 9 AS groundedness_score, value * 10 AS latency_ms FROM events"""


@query(
    f"""WITH l AS ({_LOG}), r AS (SELECT * FROM l WHERE created_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 240 HOUR)
SELECT count(*) AS total_queries, count(*) FILTER (was_cached) AS cached_queries, count(*) FILTER (intent = 'regulation_search') AS regulation_searches, count(*) FILTER (intent = 'clause_lookup') AS clause_lookups,
  count(*) FILTER (intent = 'out_of_scope') AS out_of_scope, count(*) FILTER (reflection_triggered) AS reflection_count, count(*) FILTER (low_confidence) AS low_confidence_count, count(*) FILTER (error_count > 0) AS error_queries,
  round(avg(quality_score), 4) AS avg_quality_score, round(avg(citation_coverage), 4) AS avg_citation_coverage, round(avg(groundedness_score), 4) AS avg_groundedness, round(avg(latency_ms), 0) AS avg_latency_ms,
  round(quantile_cont(latency_ms, 0.5), 0) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 0) AS p95_latency_ms, round(quantile_cont(latency_ms, 0.99), 0) AS p99_latency_ms, CAST(240 AS INTEGER) AS period_hours FROM r"""
)
def usage_summary(spark, d):
    """The ten days before a moment, of the events as a query log."""
    log = spark.sql(_LOG.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    return O.usage_summary(log, F.lit("2024-01-20 00:00:00").cast("timestamp"), 240)


@query("SELECT doc_id AS id, md5(text) AS content, CAST(-1 AS INTEGER) AS chunk_index, coalesce(source, '') AS source_file FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def documents_by_id(spark, d):
    """The documents that bear a benchmark text's number, from a table without chunk_index and source_file."""
    chunks = _texts(spark, d).select("id", "text", F.to_json(F.struct("source")).alias("metadata"))
    return L.by_id(chunks, table(spark, d, "benchmark").select(F.col("item_id").alias("id"))).select("id", F.md5("content").alias("content"), F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), "source_file")


@query(
    """SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS position
FROM conversations WHERE turn % 4 = 0 OR turn % 4 = 1 QUALIFY position <= 20"""
)
def owned_history(spark, d):
    """Of each conversation the first turns of user 1 (here one turn in four) and of nobody (another one)."""
    user = F.nullif((F.col("turn") % 4).cast("int"), F.lit(0))
    messages = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), user.alias("user_id"), F.struct("turn", "role", "text").alias("created_at"), "turn", "role")
    return L.owned_history(messages, 1, 20).select(F.col("session_id").alias("conv_id"), "turn", "role", "position")


@query(
    """SELECT doc_id, coalesce(CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE '52.' || doc_id END, CASE WHEN source = 'src1' THEN NULL ELSE source END) AS section_number FROM documents"""
)
def section_numbers(spark, d):
    """Section numbers of metadata that lacks one, has an empty one, or has one; empty parts of one source."""
    number = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.concat(F.lit("52."), F.col("doc_id").cast("string")))
    metadata = F.to_json(F.struct(number.alias("section_number"), F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("part")))
    return table(spark, d, "documents").select("doc_id", L.section_number(metadata).alias("section_number"))


@query(
    """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER) = 69, false) AS has_k, coalesce(event_type = 'view' AND user_id % 5 = 2, false) AS has_tags, coalesce(user_id % 5 = 2, false) AS has_two FROM events"""
)
def json_contained(spark, d):
    """Whether JSON of the events holds an object in an object, elements of an array in any order, and objects in arrays."""
    text = F.concat(F.lit('{"tags": ["'), F.col("event_type"), F.lit('", {"of": '), (F.col("user_id") % 5).cast("string"), F.lit('}], "props": '), F.col("props"), F.lit("}"))
    holds = {"has_k": {"props": {"k": 69}}, "has_tags": {"tags": [{"of": 2}, "view"]}, "has_two": {"tags": [{"of": 2}]}}
    return table(spark, d, "events").select("event_id", F.parse_json(text).alias("v")).select("event_id", *(J.json_contains(F.col("v"), x).alias(n) for n, x in holds.items()))


@query()
def recut_chunks(spark, d):
    """The headed documents' chunks, cut again where words and marks, counted one by one, are more than 300."""
    found = G.sections(G.lines(_headed(spark, d))).withColumn("source", F.lit("FAR"))
    fine = H.Limits(target=200, most=300, count=H.words_and_marks)
    return H.recut(H.chunk_sections(found), fine).withColumn("text", F.md5("text"))
