"""Registered queries of reports, run records, logs and limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.functions import answers as Q
from lexilake.functions import questions as K
from lexilake.functions import records as P
from lexilake.functions import routing as V
from lexilake.functions import text as T
from lexilake.operators import reports as O
from lexilake.operators import search as X
from lexilake.operators import upkeep as U
from lexilake.plans.registry import _ANCHORED, _BASE, _CLASSIFIED, _DENSE, _FUSED, _LEXICAL, _SENT, _TOKENS, query, rrf_fusion
from lexilake.session import table
from lexilake.sources import files as S


@query("SELECT coalesce(nullif(lang, 'de'), 'UNKNOWN') AS model, count(*) AS n FROM documents GROUP BY 1")
def model_mix(spark, d):
    model = F.coalesce(F.nullif("lang", F.lit("de")), F.lit("UNKNOWN"))
    return table(spark, d, "documents").groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, list_sort(list(n_chars))[CAST(round_even(0.5 * (count(*) - 1), 0) AS INT) + 1] AS p50, list_sort(list(n_chars))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INT) + 1] AS p90 FROM documents GROUP BY 1")
def percentile_rounded(spark, d):
    return O.at_index(table(spark, d, "documents"), ["source"], "n_chars", p50=O.rounded(0.5), p90=O.rounded(0.9))


@query(
    """WITH c AS (SELECT l_returnflag, round(l_discount * 10, 1) AS v FROM lineitem)
SELECT l_returnflag, list_sort(list(v))[CAST(floor(count(*) * CAST(0.5 AS DOUBLE)) AS INT) + 1] AS p50, list_sort(list(v))[CAST(floor(count(*) * CAST(0.9 AS DOUBLE)) AS INT) + 1] AS p90,
  round(100.0 * count(*) FILTER (v < 0.4) / count(*), 1) AS low_pct, round(100.0 * count(*) FILTER (v < 0.25) / count(*), 1) AS very_low_pct FROM c GROUP BY 1"""
)
def percentile_truncated(spark, d):
    c = table(spark, d, "lineitem").select("l_returnflag", F.round(F.col("l_discount") * 10, 1).alias("v"))
    share = lambda most: F.round(F.count_if(F.col("v") < most) * 100.0 / F.count(F.lit(1)), 1)
    shares = c.groupBy("l_returnflag").agg(share(0.4).alias("low_pct"), share(0.25).alias("very_low_pct"))
    return O.at_index(c, ["l_returnflag"], "v", p50=O.truncated(0.5), p90=O.truncated(0.9)).join(shares, "l_returnflag")


_CHUNKS = f"WITH s AS (SELECT doc_id, unnest({_SENT}) AS text FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '52.236-1' || chr(10) || '52.236-' || doc_id || ' title' || chr(10) || text ELSE text END AS text FROM documents))"
_REPORT = f""", t AS (SELECT doc_id, {_TOKENS.format(t='text')} AS n, {_ANCHORED} AS anchor FROM s WHERE text <> ''),
r AS (SELECT doc_id, count(*) AS chunks, round(count(*) FILTER (n < 80) / count(*) * 100, 2) AS tiny_pct, round(count(*) FILTER (n < 80 AND anchor) / count(*) * 100, 2) AS anchor_tiny_pct, round(avg(n), 1) AS avg_tok, max(n) AS max_tok,
  list_sort(list(n))[CAST(round_even(0.5 * (count(*) - 1), 0) AS INT) + 1] AS p50_tok, list_sort(list(n))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INT) + 1] AS p90_tok FROM t GROUP BY 1)"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as chunks; every third document begins with anchors."""
    text = F.expr("case when doc_id % 3 = 0 then '52.236-1\\n52.236-' || doc_id || ' title\\n' || text else text end")
    return table(spark, d, "documents").select("doc_id", F.explode(T.sentences(text)).alias("text"))


@query(_CHUNKS + _REPORT + " SELECT *, tiny_pct > 20 AS high_tiny FROM r")
def document_report(spark, d):
    return O.document_report(_pieces(spark, d))


@query(_CHUNKS + _REPORT + " SELECT count(*) AS docs, CAST(sum(chunks) AS BIGINT) AS total_chunks, round(sum(chunks * tiny_pct) / sum(chunks), 2) AS weighted_tiny_pct, count(*) FILTER (tiny_pct > 20) AS high_tiny_docs FROM r")
def corpus_report(spark, d):
    return O.corpus_report(O.document_report(_pieces(spark, d)))


@query(
    """SELECT doc_id, score, replace(left(text, 120) || CASE WHEN length(text) > 120 THEN '...' ELSE '' END, chr(10), ' ') AS preview
FROM (SELECT doc_id, text, round(length(regexp_replace(text, '[^a-z]', '', 'g')) / length(text), 6) AS score FROM documents) ORDER BY score NULLS LAST, doc_id LIMIT 10"""
)
def worst_chunks(spark, d):
    letters = F.char_length(F.regexp_replace("text", "[^a-z]", ""))
    scored = table(spark, d, "documents").withColumn("score", F.round(F.try_divide(letters, F.char_length("text")), 6))
    return O.worst(scored, "score", "doc_id", "text")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def random_sample(spark, d):
    return O.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, seed=7)


_CASES = f"""WITH c AS (SELECT doc_id, doc_id % 2 = 0 AS cited, n_chars / 1000 AS seconds, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN ['QUI', 'tion'] ELSE ['zzz'] END AS keywords, CASE doc_id % 5 WHEN 0 THEN 'FAR' WHEN 1 THEN '' ELSE NULL END AS expected, [source, CASE WHEN doc_id % 3 = 0 THEN 'FAR' ELSE 'EM385' END] AS regulations,
  CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 7 = 0 THEN '{P.FALLBACK}: ' || text WHEN doc_id % 3 = 0 THEN text || ' far 52' ELSE text END AS answer FROM documents),
g AS (SELECT *, trim(answer, ' ' || chr(9) || chr(10) || chr(13)) AS said FROM c),
r AS (SELECT doc_id, seconds, contains(said, '{P.FALLBACK}') AS fallback, regexp_matches(said, '{P.CASE_CITATION}', 'i') AS has_citation, array_to_string(list_filter([CASE WHEN said = '' THEN 'empty_response' END, CASE WHEN contains(said, '{P.FALLBACK}') THEN 'fallback_response' END,
  CASE WHEN cited AND NOT regexp_matches(said, '{P.CASE_CITATION}', 'i') THEN 'missing_citation_marker' END, CASE WHEN keywords IS NOT NULL AND len(list_filter(keywords, lambda k: contains(lower(said), lower(k)))) = 0 THEN 'missing_expected_keywords' END,
  CASE WHEN coalesce(expected, '') <> '' AND NOT list_contains(regulations, expected) THEN 'unexpected_regulation_type' END, CASE WHEN seconds > 2 THEN 'latency_exceeded' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers: some blank, some without evidence, some that cite."""
    keywords = "case when doc_id % 4 = 0 then null when doc_id % 3 = 0 then array('QUI', 'tion') else array('zzz') end"
    answer = f"case when doc_id % 11 = 0 then '  ' when doc_id % 7 = 0 then '{P.FALLBACK}: ' || text when doc_id % 3 = 0 then text || ' far 52' else text end"
    c = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("seconds"), F.expr(answer).alias("answer"), F.expr(keywords).alias("k"), F.expr("case doc_id % 5 when 0 then 'FAR' when 1 then '' end").alias("e"), F.array("source", F.expr("if(doc_id % 3 = 0, 'FAR', 'EM385')")).alias("r"))
    reasons = P.gate_reasons(F.col("answer"), F.col("doc_id") % 2 == 0, F.col("k"), F.col("e"), F.col("r"), F.col("seconds"), F.lit(2))
    return c.select("doc_id", "seconds", F.col("answer").contains(P.FALLBACK).alias("fallback"), F.col("answer").rlike("(?i)" + P.CASE_CITATION).alias("has_citation"), F.array_join(reasons, ",").alias("reasons"))


@query(_CASES + " SELECT * FROM r")
def case_results(spark, d):
    return _cases(spark, d)


@query(
    _CASES + """, a AS (SELECT round(avg(CAST(reasons = '' AS INT)), 6) AS pass_rate, round(avg(CAST(fallback AS INT)), 6) AS fallback_rate, round(avg(CAST(has_citation AS INT)), 6) AS citation_rate, round(avg(seconds), 6) AS avg_latency FROM r)
SELECT *, pass_rate >= 0.85 AND fallback_rate <= 0.2 AND citation_rate >= 0.85 AND avg_latency <= 12 AS holds FROM a"""
)
def end_to_end_gate(spark, d):
    return O.end_to_end_gate(_cases(spark, d).withColumn("passed", F.col("reasons") == ""))


_PATHS = """WITH e AS (SELECT *, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ['Router: intent=clause_lookup conf=1.0', 'Tool: clause_lookup'] WHEN 2 THEN ['Clarifier: asked', 'Router: intent= '] WHEN 3 THEN ['Start', 'Router: intent=regulation_search conf=0.80', 'Self-healing: Added 3'] WHEN 4 THEN ['QualityGate: low'] ELSE [] END AS path,
  CASE WHEN event_id % 5 = 0 THEN event_id % 2 = 0 END AS flag, ['write a letter, also include x', 'Draft the RFI', 'Closeout of stored materials', 'offsite place', 'document generator', 'the Shipyard', 'What  are they', 'hello'][CAST(event_id % 8 AS INT) + 1] AS question, CASE event_id % 3 WHEN 0 THEN 'Dear sir' WHEN 1 THEN 'The Contracting Officer' ELSE 'an error' END AS answer, CASE event_id % 4 WHEN 0 THEN 'Clarify' WHEN 1 THEN 'copilot' END AS mode, CAST(event_id % 3 AS INT) AS documents FROM events),
p AS (SELECT *, CASE WHEN coalesce(len(path), 0) = 0 THEN 'unknown' WHEN len(list_filter(path, lambda x: contains(x, 'clause_lookup'))) > 0 THEN 'clause_lookup' WHEN len(list_filter(path, lambda x: contains(x, 'Clarifier:'))) > 0 THEN 'clarifier' WHEN len(list_filter(path, lambda x: contains(x, 'regulation_search'))) > 0 THEN 'regulation_search' ELSE 'other' END AS summary,
  regexp_extract(list_filter(path, lambda x: regexp_matches(x, 'intent=\\s*\\S'))[1], 'intent=\\s*(\\S+)', 1) AS intent, coalesce(flag, len(list_filter(path, lambda x: contains(x, 'Reflection: Low') OR contains(x, 'Self-healing: Added') OR contains(x, 'QualityGate:'))) > 0, false) AS reflected,
  CASE WHEN regexp_matches(lower(question), 'also include|add clause|include 52\\.|include far') THEN 'letter_amendment' WHEN regexp_matches(lower(question), 'write |draft |serial letter|rea|rfi') THEN 'letter_request' WHEN regexp_matches(lower(question), 'commissioning|punchlist|closeout|substantial completion') THEN 'lifecycle' WHEN regexp_matches(lower(question), 'off site|off-site|offsite|stored materials') THEN 'offsite_storage' WHEN contains(lower(question), 'document generator') THEN 'product_ui' WHEN regexp_matches(lower(question), 'gao|shipyard|puget sound') THEN 'fact_heavy' WHEN regexp_matches(lower(question), '\\bwhat\\s+(is|are)\\b') THEN 'definition' ELSE 'other' END AS category FROM e),
v AS (SELECT *, CASE category WHEN 'definition' THEN CASE WHEN summary = 'clarifier' THEN 'FAIL' ELSE 'PASS' END WHEN 'offsite_storage' THEN CASE WHEN summary = 'clarifier' OR lower(coalesce(mode, '')) = 'clarify' THEN 'FAIL' WHEN documents <= 0 THEN 'WARN' ELSE 'PASS' END WHEN 'letter_amendment' THEN CASE WHEN contains(answer, 'error') OR summary = 'clarifier' THEN 'FAIL' WHEN contains(lower(answer), 'dear') THEN 'PASS' ELSE 'WARN' END
  WHEN 'lifecycle' THEN CASE WHEN summary = 'clarifier' THEN 'FAIL' WHEN contains(lower(answer), 'contracting officer') THEN 'WARN' ELSE 'PASS' END WHEN 'product_ui' THEN CASE WHEN summary = 'clarifier' OR mode IS NOT NULL THEN 'PASS' ELSE 'WARN' END WHEN 'fact_heavy' THEN 'WARN' ELSE 'INFO' END AS verdict FROM p)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs with steps, questions and answers."""
    path = "case event_id % 6 when 1 then array('Router: intent=clause_lookup conf=1.0', 'Tool: clause_lookup') when 2 then array('Clarifier: asked', 'Router: intent= ') when 3 then array('Start', 'Router: intent=regulation_search conf=0.80', 'Self-healing: Added 3') when 4 then array('QualityGate: low') when 5 then cast(array() as array<string>) end"
    question = "array('write a letter, also include x', 'Draft the RFI', 'Closeout of stored materials', 'offsite place', 'document generator', 'the Shipyard', 'What  are they', 'hello')[cast(event_id % 8 as int)]"
    e = table(spark, d, "events").select(
        "event_id", F.expr(path).alias("path"), F.expr("case when event_id % 5 = 0 then event_id % 2 = 0 end").alias("flag"), F.expr(question).alias("question"),
        F.expr("case event_id % 3 when 0 then 'Dear sir' when 1 then 'The Contracting Officer' else 'an error' end").alias("answer"), F.expr("case event_id % 4 when 0 then 'Clarify' when 1 then 'copilot' end").alias("mode"), (F.col("event_id") % 3).cast("int").alias("documents"),
    )
    known = e.select("*", P.path_summary(F.col("path")).alias("summary"), P.path_intent(F.col("path")).alias("intent"), P.reflected(F.col("flag"), F.col("path")).alias("reflected"), P.category(F.col("question")).alias("category"))
    return known.withColumn("verdict", P.case_verdict(F.col("category"), F.col("summary"), F.col("mode"), F.col("documents"), F.col("answer")))


@query(_PATHS + " SELECT event_id, summary, intent, reflected, category, verdict FROM v")
def run_rows(spark, d):
    return _runs(spark, d).select("event_id", "summary", "intent", "reflected", "category", "verdict")


@query(_PATHS + " SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def verdict_counts(spark, d):
    return _runs(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_type, round(avg(value / 10), 2) AS mean_s, min(value / 10) AS min_s, max(value / 10) AS max_s, count(*) FILTER (value / 10 < 4) AS fast, count(*) FILTER (value / 10 >= 4 AND value / 10 < 8) AS fair, count(*) FILTER (value / 10 >= 8) AS slow FROM events GROUP BY 1"""
)
def latency_summary(spark, d):
    return O.latency_summary(table(spark, d, "events").select("event_type", (F.col("value") / 10).alias("s")), ["event_type"], "s")


@query(
    _BASE + _DENSE + _LEXICAL + _FUSED + """, n AS (SELECT *, CASE WHEN rrf_score > 0 AND rrf_score <= 0.05 THEN least(greatest(rrf_score * 50, 0.1), 1.0) ELSE least(greatest(rrf_score, 0.0), 1.0) END AS s, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS r FROM fused)
SELECT query_id, count(*) AS doc_count, round(max(s) FILTER (r = 1), 6) AS top_norm, round(avg(s), 6) AS avg_norm FROM n GROUP BY 1"""
)
def evidence_summary(spark, d):
    ranked = rrf_fusion(spark, d).withColumn("place", F.struct((-F.col("rrf_score")).alias("s"), "id"))
    return O.evidence_summary(ranked, "query_id", "place", "rrf_score")


@query(
    """SELECT event_id, sha256(lower(trim(' ' || event_type || chr(10), ' ' || chr(10)))) AS query_hash, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS error_count, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS errors, CASE WHEN event_id % 2 = 0 THEN 'grounded' WHEN event_id % 5 = 0 THEN NULL ELSE 'copilot' END AS mode FROM events"""
)
def analytics_log(spark, d):
    errors = F.expr("if(event_id % 3 = 0, cast(array() as array<string>), array(event_type))")
    mode = F.coalesce(F.nullif(F.expr("if(event_id % 2 = 0, 'grounded', '')"), F.lit("")), F.expr("if(event_id % 5 = 0, null, 'copilot')"))
    text = F.concat(F.lit(" "), F.col("event_type"), F.lit("\n"))
    return table(spark, d, "events").select("event_id", P.query_hash(text).alias("query_hash"), F.size(errors).alias("error_count"), F.nullif(F.array_join(errors, "|"), F.lit("")).alias("errors"), mode.alias("mode"))


@query(
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'BAD' ELSE 'bad' END AS response, quality = 1 OR toxic <> 1 AS known_response, doc_id % 4 <> 0 AS known_id FROM labels"""
)
def feedback_checked(spark, d):
    """Feedback with what its checks say; rows that fail one go to quarantine."""
    key = F.md5(F.col("doc_id").cast("string"))
    given = F.when(F.col("doc_id") % 4 == 0, F.left(key, F.lit(31))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("{"), key, F.lit("}"))).otherwise(F.concat(F.lit("urn:uuid:"), key))
    response = F.expr("case when quality = 1 then 'good' when toxic = 1 then 'BAD' else 'bad' end")
    return table(spark, d, "labels").select("doc_id", response.alias("response"), response.isin("good", "bad").alias("known_response"), P.is_uuid(given).alias("known_id"))


@query(
    """WITH h AS (SELECT event_id, event_type || '-é-' || user_id AS u, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(event_type || '-é-' || user_id)) AS s FROM events)
SELECT event_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(s, 17, 1)) AS INT) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS user_uuid FROM h"""
)
def user_uuids(spark, d):
    user = F.concat(F.col("event_type"), F.lit("-é-"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", P.user_uuid(user).alias("user_uuid"))


@query(
    """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN nullif(regexp_extract(text || CASE WHEN turn % 3 <> 0 THEN ' see FAR 52.' || turn || ' there' ELSE '' END, '(?i)""" + Q.CITATION + """'), '') END AS hit FROM conversations)
SELECT conv_id, turn, last_value(hit IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS prior_clause FROM c"""
)
def prior_clause(spark, d):
    """The last citation of the assistant within the four turns before."""
    text = F.expr("text || case when turn % 3 <> 0 then ' see FAR 52.' || turn || ' there' else '' end")
    hit = F.when(F.col("role") == "assistant", F.nullif(F.regexp_extract(text, "(?i)" + Q.CITATION, 0), F.lit("")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(hit, ignorenulls=True).over(w).alias("prior_clause"))


_GUARD = "'{\"action\": ' || CASE event_id % 3 WHEN 0 THEN '\"BLOCK\"' WHEN 1 THEN 'null' ELSE '\"allow\"' END || ', \"blocked\": ' || CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END || ', \"confidence\": ' || CASE WHEN event_id % 2 = 0 THEN '\"0.5\"' ELSE '\"high\"' END || ', \"tier_used\": ' || (event_id % 4) || ', \"explanation\": \"' || event_type || '\"}'"


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'block' ELSE 'allow' END AS action, event_id % 3 = 0 OR event_id % 5 = 0 AS should_block, CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE END AS confidence, CAST(event_id % 4 AS INT) AS tier_used, event_type AS reason FROM events"""
)
def guard_verdicts(spark, d):
    return table(spark, d, "events").select("event_id", P.guard_verdict(F.expr(_GUARD)).alias("v")).select("event_id", "v.*")


@query("SELECT event_id, i AS position, CASE WHEN i = 0 AND event_id % 2 = 0 THEN 0.25 WHEN i = 2 THEN 7.0 ELSE 0.0 END AS score FROM events, (SELECT unnest([0, 1, 2]) AS i)")
def reply_scores(spark, d):
    """Scores of a reply joined to positions, 0 where the reply has none; its malformed items are left out."""
    name = "if(event_id % 2 = 0, 'scores', 'results')"
    reply = F.expr("'{\"' || " + name + " || '\": [{\"index\": ' || if(event_id % 2 = 0, '0', '\"0\"') || ', \"score\": 0.25}, \"x\", {\"index\": 1, \"score\": \"3\"}, {\"index\": 2, \"score\": 7}]}'")
    scores = F.map_from_entries(P.reply_scores(reply))
    each = table(spark, d, "events").select("event_id", scores.alias("m"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("position"))
    return each.select("event_id", "position", F.coalesce(F.try_element_at("m", F.col("position")), F.lit(0.0)).alias("score"))


@query("SELECT user_id, CAST(regexp_extract(arg_min('took ' || value || 's', event_id), '(\\d+\\.\\d+)s', 1) AS DOUBLE) AS seconds FROM events WHERE event_type = 'click' GROUP BY 1")
def message_seconds(spark, d):
    """Seconds told by the first message of each user that holds a keyword."""
    e = table(spark, d, "events").select("user_id", "event_id", F.concat(F.col("event_type"), F.lit(" took "), F.col("value").cast("string"), F.lit("s")).alias("message"))
    first = F.min_by(F.when(F.col("message").contains("click"), F.col("message")), F.when(F.col("message").contains("click"), F.col("event_id")))
    return e.where(F.col("message").contains("click")).groupBy("user_id").agg(P.message_seconds(first).alias("seconds"))


@query("SELECT event_id, array_to_string(list_sort(list_distinct([event_id % 7, event_id % 3, 2])), ',') AS numbers FROM events")
def row_lists(spark, d):
    text = F.expr("' ' || (event_id % 7) || ',, ' || (event_id % 3) || ' ,2,'")
    return table(spark, d, "events").select("event_id", F.array_join(P.row_numbers(text), ",").alias("numbers"))


@query()
def term_hashes(spark, d):
    terms = F.explode(F.array_distinct(T.words(F.lower("text")))).alias("term")
    return table(spark, d, "documents").select(terms).distinct().select("term", P.term_hash(F.col("term")).alias("term_id"))


_EVENTS = """e AS (SELECT event_id, u, epoch_us(ts) AS time, coalesce(event_type, '') AS kind, row_number() OVER (PARTITION BY u ORDER BY ts, event_id) AS n FROM (SELECT *, coalesce(CAST(user_id AS VARCHAR), 'null:') AS u FROM events) WHERE ts IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {_EVENTS}, r AS (SELECT event_id, u, n, true AS allowed, [time] AS hits FROM e WHERE n = 1
UNION ALL SELECT event_id, u, n, len(h) < 2, CASE WHEN len(h) < 2 THEN list_append(h, time) ELSE h END FROM (SELECT e.*, list_filter(hits, lambda t: t > e.time - 86400000000) AS h FROM r JOIN e ON e.u = r.u AND e.n = r.n + 1))
SELECT event_id, allowed FROM r"""
)
def rate_limited(spark, d):
    return O.rate_limited(table(spark, d, "events"), most=2, seconds=86_400)


@query(
    f"""WITH RECURSIVE {_EVENTS}, r AS (SELECT event_id, u, n, false AS locked, CASE WHEN kind = 'error' THEN 1 ELSE 0 END AS failed, CAST(NULL AS BIGINT) AS until FROM e WHERE n = 1
UNION ALL SELECT event_id, u, n, held, CASE WHEN held THEN failed WHEN kind = 'signup' THEN 0 WHEN kind = 'error' THEN failed + 1 ELSE failed END,
  CASE WHEN held THEN until WHEN kind = 'signup' THEN NULL WHEN kind = 'error' AND failed + 1 >= 3 THEN time + 604800000000 ELSE until END
FROM (SELECT e.*, failed, until, coalesce(e.time < until, false) AS held FROM r JOIN e ON e.u = r.u AND e.n = r.n + 1))
SELECT event_id, locked FROM r"""
)
def locked_out(spark, d):
    return O.locked_out(table(spark, d, "events"), most=3, minutes=60 * 24 * 7)


@query("SELECT doc_id, source AS namespace FROM documents WHERE NOT (source = (SELECT min(source) FROM documents) OR starts_with(source, (SELECT min(source) FROM documents) || '-')) OR source IS NULL")
def namespace_cleared(spark, d):
    """A table without the rows of one namespace; rows without a namespace stay."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("namespace"))
    name = docs.agg(F.min("namespace").alias("n")).first()["n"]
    return docs.where(~F.coalesce(U.in_namespace(F.col("namespace"), name or ""), F.lit(False)))


@query("SELECT conv_id, CAST(count(*) - conv_id % 3 AS INTEGER) AS n, string_agg(turn, ',' ORDER BY turn) FILTER (place > conv_id % 3) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) GROUP BY 1 HAVING count(*) > conv_id % 3")
def run_offsets(spark, d):
    """The entries that a run added: those beyond what its thread held before (here 0 to 2)."""
    turns = F.array_sort(F.collect_list("turn"))
    each = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("all")).where("size(all) > conv_id % 3")
    new = F.slice("all", (F.col("conv_id") % 3 + 1).cast("int"), F.size("all"))
    return each.select("conv_id", F.size(new).alias("n"), F.array_join(new.cast("array<string>"), ",").alias("turns"))


@query(
    """WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda t: NOT list_contains(string_split('"""
    + " ".join(T.ENGLISH_STOP_WORDS)
    + """', ' '), t))) AS a FROM documents)
SELECT doc_id, CAST(len(a) AS INTEGER) AS n, md5(array_to_string(list_sort(a), ' ')) AS terms FROM w"""
)
def search_vectors(spark, d):
    terms = T.search_terms(F.col("text"))
    return table(spark, d, "documents").select("doc_id", terms.alias("a")).select("doc_id", F.size("a").alias("n"), F.md5(F.array_join("a", " ").cast("binary")).alias("terms"))


_CELLS = """SELECT l_orderkey AS table_id, l_linenumber * 1000000 + l_partkey AS cell, CAST(l_linenumber % 4 AS INT) AS row_from, CAST(l_linenumber % 4 + l_suppkey % 2 AS INT) AS row_to, CAST(l_partkey % 3 AS INT) AS col_from,
  CAST(l_partkey % 3 + l_suppkey % 2 AS INT) AS col_to, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE ' p' || l_partkey || ' ' END AS text, l_linenumber % 4 = 1 AND l_linestatus = 'F' AS header FROM lineitem"""


@query(
    f"""WITH c AS ({_CELLS}), a AS (SELECT *, unnest(range(row_from, least(row_to, 3) + 1)) AS r FROM c), b AS (SELECT *, unnest(range(col_from, least(col_to, 2) + 1)) AS k FROM a),
g AS (SELECT table_id, r, k, arg_min(trim(text), cell) FILTER (trim(text) <> '') AS t, bool_or(header) AS h FROM b GROUP BY ALL),
p AS (SELECT table_id, coalesce(min(r) FILTER (h), 0) AS top FROM g GROUP BY 1),
f AS (SELECT p.table_id, top, x.r, y.k, coalesce(t, '') AS t FROM p, range(4) x(r), range(3) y(k) LEFT JOIN g ON g.table_id = p.table_id AND g.r = x.r AND g.k = y.k WHERE x.r >= top),
l AS (SELECT table_id, r, top, string_agg(CASE WHEN r = top AND t = '' THEN 'col_' || (k + 1) ELSE t END, ' | ' ORDER BY k) AS s, bool_or(t <> '') AS filled FROM f GROUP BY ALL)
SELECT table_id, CAST(count(*) - 1 AS INTEGER) AS n, trim(string_agg(s, chr(10) ORDER BY r)) AS text FROM l WHERE r = top OR filled GROUP BY 1"""
)
def table_grids(spark, d):
    """Tables rebuilt from spans of cells, as text."""
    cells = spark.sql(_CELLS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))
    tables = cells.select("table_id").distinct().withColumns({"num_rows": F.lit(4), "num_cols": F.lit(3)})
    return S.table_grid(cells, tables).select("table_id", F.size("rows").alias("n"), S.table_text(F.col("headers"), F.col("rows")).alias("text"))


@query(
    """WITH x AS (SELECT doc_id // 20 AS query_id, doc_id % 20 + 1 AS i, '--- Document ' || (doc_id % 20 + 1) || ' ---' || chr(10) || 'Source: ' || coalesce(source, 'Unknown') || chr(10) || 'Regulation: ' || coalesce(nullif(lang, 'de'), 'Unknown') || chr(10)
  || 'Section: N/A' || chr(10) || 'Score: ' || printf('%.3f', doc_id % 8 / 8.0) || chr(10) || chr(10) || 'Content:' || chr(10) || left(text, 1200) || CASE WHEN length(text) > 1200 THEN '...' ELSE '' END || chr(10) || chr(10) AS t FROM documents),
g AS (SELECT query_id, list({'used': length(t) // 4, 'n': CAST(1 AS BIGINT), 's': t} ORDER BY i) AS a FROM x GROUP BY 1),
r AS (SELECT query_id, list_reduce(a, lambda s, x: CASE WHEN s.used + x.used <= 1000 THEN {'used': s.used + x.used, 'n': s.n + 1, 's': CASE WHEN s.n = 0 THEN x.s ELSE s.s || chr(10) || x.s END} ELSE s END, {'used': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 's': ''}) AS r FROM g)
SELECT query_id, r.n AS n, r.s AS context FROM r WHERE r.n > 0"""
)
def formatted_contexts(spark, d):
    rows = table(spark, d, "documents").select(
        F.expr("doc_id div 20").alias("query_id"), (F.col("doc_id") % 20 + 1).alias("rank"), F.col("text").alias("content"), "source",
        F.nullif("lang", F.lit("de")).alias("regulation"), F.lit(None).cast("string").alias("section"), (F.col("doc_id") % 8 / 8).alias("score"),
    )
    return X.formatted_context(rows, 1000)


#: what stands before the users' texts, in turn
_ASKED = ("What about inspection there? ", "also include this clause ", "how does the vendor log in here ", "what does the vendor say ", "", "FAR 52.236-2 ", "draft a letter ")
_TURNS = f"""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN CASE conv_id % 3 WHEN 0 THEN text || ' FAR 52.236-' || turn WHEN 1 THEN 'Dear Sir, ' || text ELSE text END
  WHEN (conv_id + turn) % 8 = 7 THEN 'what is a ' || upper(left(text, 3)) || '?' {' '.join(f"WHEN (conv_id + turn) % 8 = {i} THEN '{p}' || text" for i, p in enumerate(_ASKED))} ELSE text END AS text FROM conversations"""
_PRODUCT = " OR ".join(f"contains(lower(q), '{x}')" for x in V.PRODUCT_SIGNALS)


@query(
    rf"""WITH t AS ({_TURNS}), h AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN nullif(regexp_extract(text, '{Q.CITATION}', 0, 'i'), '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS prior,
  coalesce(regexp_matches(string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') END, ' ') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '{V.LETTER_TEXT}'), false) AS letter FROM t),
x AS (SELECT conv_id, turn, prior, letter, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ') AS q FROM h WHERE role = 'user'), {_CLASSIFIED},
n AS (SELECT *, CASE WHEN q = '' THEN 0 ELSE len(string_split(q, ' ')) END AS words, intent = 'regulation_search' AND clause_reference IS NULL AS bare FROM classified),
o AS (SELECT *, CASE WHEN bare AND confidence < 0.7 AND words < 12 THEN prior ELSE clause_reference END AS clause FROM n),
u AS (SELECT *, bare AND ((({_PRODUCT}) AND NOT regexp_matches(q, '{V.ROLE}')) OR (words <= 5 AND clause IS NULL AND keywords = '' AND NOT regexp_matches(q, '{V.DEFINITION}'))) AS unclear,
  regexp_matches(q, '{V.AMENDS}') AND (letter OR regexp_matches(q, '{V.OF_LETTER}')) AS amends, CASE WHEN bare THEN nullif(upper(regexp_extract(q, '{V.ACRONYM}', 1)), '') END AS acronym, intent = 'out_of_scope' AND document_type IS NULL AS away FROM o)
SELECT conv_id, turn, CASE WHEN acronym IS NOT NULL THEN 'end' WHEN amends THEN 'data_retrieval' WHEN unclear THEN 'clarifier' WHEN away THEN 'end' ELSE 'data_retrieval' END AS next,
  CASE WHEN acronym IS NOT NULL OR unclear THEN 'clarify' WHEN away THEN 'copilot' END AS mode, acronym, clause AS clause_reference, CASE WHEN amends THEN 'letter' ELSE document_type END AS document_type FROM u"""
)
def routed_questions(spark, d):
    """Where the users' whole texts go, each with a question's opening before it (of one in eight an acronym alone)."""
    turns = spark.sql(_TURNS.replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, d, "conversations"))
    asked = V.with_history(turns).where("role = 'user'").withColumnRenamed("text", "question")
    return V.route(K.classify(asked)).select("conv_id", "turn", "next", "mode", "acronym", "clause_reference", "document_type")
