"""Every registered query of the library's own operators, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.functions import answers as Q
from lexilake.functions import intent as I
from lexilake.functions import questions as K
from lexilake.functions import text as T
from lexilake.operators import chunking as H
from lexilake.operators import context as C
from lexilake.operators import reports as O
from lexilake.operators import retrieval as R
from lexilake.operators import search as X
from lexilake.operators import sections as S
from lexilake.operators import sessions as A
from lexilake.operators import upkeep as U
from lexilake.session import table, written
from lexilake.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    import lexilake.plans.dispatch
    import lexilake.plans.lexical
    import lexilake.plans.reports
    import lexilake.plans.stored  # noqa: F401, all register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import lexilake.plans.dispatch
    import lexilake.plans.lexical
    import lexilake.plans.reports
    import lexilake.plans.stored  # noqa: F401, all register their queries

    return dict(_SQL)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return R.chunks(table(spark, d, "documents"), table(spark, d, "embeddings"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """All documents, for searches that need no vector."""
    return table(spark, d, "documents").withColumnRenamed("doc_id", "id")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark texts as queries, for searches that need no vector."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark texts as queries, each with the vector of the same number."""
    b, v = table(spark, d, "benchmark"), table(spark, d, "embeddings")
    return b.join(v, b["item_id"] == v["vec_id"]).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("vector"))


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COSINE = f"round({_COS.format(a='i.embedding', b='q.vector')} / (sqrt({_COS.format(a='i.embedding', b='i.embedding')}) * sqrt({_COS.format(a='q.vector', b='q.vector')})), 6)"
_BASE = """
WITH i AS (SELECT d.doc_id AS id, d.source, d.text, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
q AS (SELECT b.item_id AS query_id, b.text AS query, e.embedding AS vector FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id)"""
_DENSE = f""", dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
  FROM (SELECT q.query_id, i.id, {_COSINE} AS similarity FROM i, q)) WHERE rank <= 15)"""
_LEXICAL = """, post AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents),
terms AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM benchmark) WHERE length(term) > 1),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, id, round(count(*) / (count(*) + 1), 6) AS score FROM post JOIN terms USING (term) GROUP BY ALL)) WHERE rank <= 10)"""
_FUSED = """, fused AS (SELECT query_id, id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 9) AS rrf_score, max(d) AS in_dense, max(l) AS in_lexical FROM (
  SELECT query_id, id, rank, 1 AS d, 0 AS l FROM dense UNION ALL SELECT query_id, id, rank, 0, 1 FROM lexical) GROUP BY ALL)"""


@query(_BASE + _DENSE + "SELECT query_id, id, similarity, rank FROM dense")
def dense_topk(spark, d):
    return R.dense_batch(_index(spark, d), _asked(spark, d))


@query(_BASE + _LEXICAL + "SELECT query_id, id, score, rank FROM lexical")
def lexical_topk(spark, d):
    return R.lexical_batch(_texts(spark, d), _questions(spark, d))


@query(_BASE + _DENSE + _LEXICAL + _FUSED + "SELECT * FROM fused")
def rrf_fusion(spark, d):
    return R.reciprocal_rank_fusion(R.dense_batch(_index(spark, d), _asked(spark, d)), lexical_topk(spark, d))


@query(
    _BASE + _DENSE + _LEXICAL + _FUSED + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank FROM (
  SELECT *, round(rrf_score * CASE WHEN in_dense = 1 AND in_lexical = 0 THEN 1.05 ELSE 1.0 END, 9) AS final_score FROM fused)) WHERE rank <= 10"""
)
def hybrid_boosted(spark, d):
    return R.boosted(rrf_fusion(spark, d), 10)


_ASKS, _SECTIONS, _TITLES = ("which clauses apply", "the clause on 52.236-2", "", "FAR 9.104 terms"), ("52.236-2", "9.1", "52.211"), ("Payments", "", "Matrix Notes", "Changes", "Delivery")
_PICK = "[{x}][CAST({i} % {n} AS INTEGER) + 1]"


def _pick(values, i: str) -> str:
    return _PICK.format(x=", ".join("'" + v.replace("'", "''") + "'" for v in values), i=i, n=len(values))


def _picked(values, i: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(i) % len(values) + 1).cast("int"))


@query(
    _BASE + _DENSE + _LEXICAL + _FUSED + f""", x AS (SELECT *, lower({_pick(_ASKS, 'query_id')}) AS ask, {_pick(_SECTIONS, 'id')} AS section, lower({_pick(_TITLES, 'id')}) AS title FROM fused),
y AS (SELECT *, regexp_matches(ask, '{R.CLAUSE_NUMBERS}') OR (contains(ask, 'clause') AND regexp_matches(ask, '[0-9]')) AS clause, regexp_matches(ask, '{R.START_QUESTIONS}') AND ({' OR '.join(f"starts_with(section, '{p}')" for p in R.START_CLAUSES)}) AS pref
  FROM x WHERE NOT regexp_matches(title, '{R.META_TITLES}'))
SELECT query_id, id, rrf_score, in_dense, in_lexical, final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank FROM (
  SELECT *, round(rrf_score * CASE WHEN pref THEN 1.4 ELSE 1.0 END * CASE WHEN clause AND in_lexical = 1 THEN 1.35 WHEN NOT clause AND in_dense = 1 AND in_lexical = 0 THEN 1.05 ELSE 1.0 END, 9) AS final_score FROM y)) WHERE rank <= 10"""
)
def hybrid_clause_boosts(spark, d):
    ask, section = _picked(_ASKS, "query_id"), _picked(_SECTIONS, "id")
    kept = rrf_fusion(spark, d).where(~R.meta_chunk(_picked(_TITLES, "id"), F.lit("")))
    return R.boosted(kept, 10, R.clause_like(ask), R.preferred_section(ask, section))


@query("SELECT doc_id AS id, strpos(lower(text), 'tion') AS place FROM documents WHERE strpos(lower(text), 'tion') > 0 ORDER BY place, id LIMIT 10")
def direct_text_lookup(spark, d):
    return R.direct_lookup(table(spark, d, "documents").withColumnRenamed("doc_id", "id"), "tion")


_TOKENS = "CAST(floor(len(list_filter(regexp_split_to_array(trim({t}, ' '), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) * CAST(1.3 AS DOUBLE)) AS BIGINT)"


@query(
    f"""WITH x AS (SELECT source, doc_id, {_TOKENS.format(t='text')} AS n FROM documents),
g AS (SELECT source, list(n ORDER BY doc_id) AS a FROM x GROUP BY 1)
SELECT source, CAST(r.used AS BIGINT) AS used, CAST(r.taken AS INTEGER) AS taken FROM (SELECT source, list_reduce(list_transform(a, lambda n: {{'used': n, 'taken': 1}}),
  lambda s, x: CASE WHEN s.used + x.used <= 2400 THEN {{'used': s.used + x.used, 'taken': s.taken + 1}} ELSE s END, {{'used': CAST(0 AS BIGINT), 'taken': 0}}) AS r FROM g)"""
)
def context_budget(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", T.estimated_tokens(F.col("text")).alias("n"))
    return R.greedy_budget(rows, "source", "doc_id", "n", 2400)


@query("WITH x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents), c AS (SELECT * FROM x WHERE doc_id % 100 = 0) SELECT DISTINCT x.source, x.ordinal, x.doc_id FROM x JOIN c ON x.source = c.source AND x.ordinal BETWEEN c.ordinal - 2 AND c.ordinal + 2")
def surrounding_chunks(spark, d):
    x = table(spark, d, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("ordinal"))
    return R.surrounding(x, x.where("doc_id % 100 = 0")).select("source", "ordinal", "doc_id")


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)")
def dup_groups(spark, d):
    return U.duplicate_groups(table(spark, d, "documents"), F.md5("text"))


_NORM = "trim(regexp_replace(regexp_replace(translate(text, chr(160) || '–—−', ' ---'), '\\r\\n?', chr(10), 'g'), '[ \\t\\n\\f\\v]+', ' ', 'g'), ' ')"


@query(f"SELECT source, min(doc_id) AS doc_id FROM (SELECT source, doc_id, md5({_NORM}) AS h, {_NORM} AS t FROM documents) WHERE t <> '' GROUP BY source, h")
def dedup_exact(spark, d):
    rows = table(spark, d, "documents").withColumn("t", T.normalised(F.col("text"))).where("t <> ''")
    return U.first_of_each(rows, ["source", F.md5("t")], "doc_id").select("source", "doc_id")


@query("SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1")
def dedup_delete(spark, d):
    rn = F.row_number().over(Window.partitionBy(F.md5("text")).orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", rn.alias("rn")).where("rn > 1")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def orphan_dense(spark, d):
    return U.missing_from(table(spark, d, "embeddings"), table(spark, d, "documents"), "vec_id", "doc_id").select("vec_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def orphan_sparse(spark, d):
    return U.missing_from(table(spark, d, "documents"), table(spark, d, "embeddings"), "doc_id", "vec_id").select("doc_id")


@query("SELECT coalesce(source, 'UNKNOWN') AS source, count(*) AS n FROM documents GROUP BY 1")
def source_breakdown(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("UNKNOWN")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(avg(length(text)), 1) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(quantile_cont(length(text), 0.5), 3) AS p50, round(quantile_cont(length(text), 0.9), 3) AS p90, round(quantile_cont(length(text), 0.99), 3) AS p99 FROM documents")
def char_length_stats(spark, d):
    sized = table(spark, d, "documents").select(F.char_length("text").alias("n"))
    sums = sized.agg(F.round(F.avg("n"), 1).alias("avg_chars"), F.min("n").cast("long").alias("min_chars"), F.max("n").cast("long").alias("max_chars"), F.lit(1).alias("one"))
    at = O.between(sized, [], "n", p50=0.5, p90=0.9, p99=0.99)
    return sums.join(at.select(F.lit(1).alias("one"), *(F.round(c, 3).alias(c) for c in at.columns)), "one", "left").drop("one")


@query(f"SELECT round(avg(n), 4) AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens, count(*) FILTER (n < 100) AS tiny, count(*) FILTER (n > 900) AS oversized FROM (SELECT {_TOKENS.format(t='text')} AS n FROM documents)")
def token_stats(spark, d):
    n = table(spark, d, "documents").select(T.estimated_tokens(F.col("text")).alias("n"))
    return n.agg(F.round(F.avg("n"), 4).alias("avg_tokens"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.count_if(F.col("n") < 100).alias("tiny"), F.count_if(F.col("n") > 900).alias("oversized"))


@query("SELECT source, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90 FROM documents GROUP BY 1")
def percentile_nearest_rank(spark, d):
    return O.at_index(table(spark, d, "documents"), ["source"], "n_chars", p50=O.nearest_rank(0.5), p90=O.nearest_rank(0.9))


_FIRST = "split_part(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1)"
_ANCHORED = f"(regexp_matches({_FIRST}, '{T.ANCHOR}', 'i') OR regexp_matches({_FIRST}, '{T.MANUAL_ANCHOR}'))"
_MARKED = "CASE WHEN doc_id % 3 = 0 THEN '52.236-' || doc_id || ' ' || text WHEN doc_id % 3 = 1 THEN '1-2. you must ' || text ELSE text END"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Documents, two thirds of them headed by a clause's or a section's number."""
    return table(spark, d, "documents").withColumn("text", F.expr(_MARKED))


@query(
    f"""WITH m AS (SELECT * REPLACE ({_MARKED} AS text) FROM documents), x AS (SELECT md5(text) AS h, {_TOKENS.format(t='text')} AS n, {_ANCHORED} AS a, coalesce(source, '') = '' AS m FROM m),
s AS (SELECT CAST(count(*) FILTER (n < 80 AND NOT a) AS DOUBLE) / count(*) AS tiny, CAST(count(*) FILTER (n > 800) AS DOUBLE) / count(*) AS over, CAST(count(*) FILTER (m) AS DOUBLE) / count(*) AS miss, CAST(count(*) AS DOUBLE) AS c FROM x),
g AS (SELECT CAST(count(*) AS DOUBLE) AS k FROM (SELECT h FROM x GROUP BY h HAVING count(*) > 1))
SELECT round(greatest(0.0, 100 - (least(k / c * 100, 20) + least(tiny * 200, 30) + least(over * 500, 10) + least(miss * 100, 10))), 6) AS technical_score FROM s, g"""
)
def technical_score(spark, d):
    t, n = F.col("text"), F.col("n")
    rows = _marked(spark, d).select(F.md5("text").alias("h"), T.estimated_tokens(t).alias("n"), T.is_anchor(t).alias("a"), (F.coalesce("source", F.lit("")) == "").alias("m"))
    by = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.count_if((n < 80) & ~F.col("a")).alias("tiny"), F.count_if(n > 800).alias("over"), F.count_if("m").alias("miss"))
    s = by.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 1).alias("k"), *(F.sum(x).alias(x) for x in ("tiny", "over", "miss")))
    return s.select(F.round(T.technical_score(*(F.col(x) / F.col("c") for x in ("k", "tiny", "over", "miss"))), 6).alias("technical_score"))


@query(f"SELECT doc_id, {_ANCHORED} AS anchor, regexp_matches(text, '{T.OBLIGATION}', 'i') OR regexp_matches(text, '{T.CROSS_REFERENCE}', 'i') OR len(regexp_extract_all(text, '(?i){T.CONDITION_LINE}')) >= 2 AS whole FROM (SELECT * REPLACE ({_MARKED} AS text) FROM documents)")
def anchors_and_guards(spark, d):
    return _marked(spark, d).select("doc_id", T.is_anchor(F.col("text")).alias("anchor"), T.must_stay_whole(F.col("text")).alias("whole"))


@query(
    f"""WITH d AS (SELECT count(*) AS n, count(DISTINCT len(embedding)) AS models FROM embeddings), s AS (SELECT count(*) AS n FROM documents),
o AS (SELECT (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) + (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n),
t AS (SELECT 100.0 * count(*) FILTER (n < 100 AND NOT a) / count(*) AS tiny, 100.0 * count(*) FILTER (n > 900) / count(*) AS over FROM (SELECT {_TOKENS.format(t='text')} AS n, {_ANCHORED} AS a FROM documents))
SELECT 'rows_present' AS gate, d.n > 0 AND s.n > 0 AS ok FROM d, s UNION ALL SELECT 'counts_match', d.n = s.n FROM d, s UNION ALL SELECT 'no_orphans', o.n = 0 FROM o
UNION ALL SELECT 'one_model', models = 1 FROM d UNION ALL SELECT 'few_tiny', tiny <= 5 FROM t UNION ALL SELECT 'few_oversized', over <= 1 FROM t"""
)
def promotion_gates(spark, d):
    e, t = table(spark, d, "embeddings"), F.col("text")
    one = lambda df, **c: df.agg(F.lit(1).alias("one"), *(x.alias(k) for k, x in c.items()))
    rows, n = F.count(F.lit(1)), T.estimated_tokens(t)
    # the vectors' length stands for the model that made them
    dense = one(e, d=rows, models=F.count_distinct(F.size("embedding")))
    sparse = one(table(spark, d, "documents"), s=rows, tiny=100 * F.count_if((n < 100) & ~T.is_anchor(t)) / rows, over=100 * F.count_if(n > 900) / rows)
    row = dense.join(sparse, "one").join(one(orphan_dense(spark, d), a=rows), "one").join(one(orphan_sparse(spark, d), b=rows), "one")
    c = F.col
    tests = {"rows_present": (c("d") > 0) & (c("s") > 0), "counts_match": c("d") == c("s"), "no_orphans": (c("a") == 0) & (c("b") == 0), "one_model": c("models") == 1, "few_tiny": c("tiny") <= 5, "few_oversized": c("over") <= 1}
    return row.select(F.inline(F.array(*(F.struct(F.lit(g).alias("gate"), ok.alias("ok")) for g, ok in tests.items()))))


@query("SELECT 'target-' || doc_id AS id, 'target-' || source AS namespace FROM documents UNION ALL SELECT 'pilot-' || doc_id, 'pilot-' || source FROM documents")
def namespace_promote(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("pilot-"), "doc_id").alias("id"), F.concat(F.lit("pilot-"), "source").alias("namespace"))
    return U.promote(rows, "pilot", "target")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 10 = 0")
def upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return U.upsert(o, o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), "o_orderkey")


@query("SELECT page_id, sha256(html) AS file_hash FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 2 = 0)")
def idempotent_skip(spark, d):
    p = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("file_hash"))
    return p.join(p.where("page_id % 2 = 0").select("file_hash").distinct(), "file_hash", "left_anti").select("page_id", "file_hash")


@query(
    """SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS slow, round(avg(value), 4) AS avg_value, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99
FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 240 HOUR GROUP BY 1"""
)
def analytics_summary(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("as_of"))
    recent = e.join(F.broadcast(last), F.col("ts") > F.col("as_of") - F.expr("INTERVAL 240 HOURS"))  # one row
    sums = recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("slow"), F.round(F.avg("value"), 4).alias("avg_value"))
    at = O.between(recent, ["event_type"], "value", p50=0.5, p95=0.95, p99=0.99).withColumnRenamed("event_type", "_type")
    joined = sums.join(at, F.col("event_type").eqNullSafe(F.col("_type")), "left")
    return joined.select("event_type", "n", "slow", "avg_value", *(F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM labels")
def feedback_summary(spark, d):
    return table(spark, d, "labels").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))


@query("SELECT lang, source, count(*) AS n, max(doc_id) AS latest FROM documents GROUP BY 1, 2")
def ingestion_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("latest"))


@query("SELECT conv_id, max(turn) AS last_turn, nullif(trim(left(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), 80), ' '), '') AS preview FROM conversations GROUP BY 1 ORDER BY last_turn DESC, conv_id LIMIT 50")
def thread_list(spark, d):
    return A.threads(table(spark, d, "conversations")).orderBy(F.desc("last_turn"), "conv_id").limit(50)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 50")
def chat_history(spark, d):
    t = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return t.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n <= 50").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, string_agg(role || ': ' || left(text, 200), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS context FROM conversations")
def prior_context(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, 0)
    line = F.concat(F.col("role"), F.lit(": "), F.left("text", F.lit(200)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(line).over(w), "\n").alias("context"))


@query("SELECT event_id, sha256(lower(trim(event_type, ' ')) || '|cot:' || CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END) AS cache_key FROM events WHERE ts + INTERVAL 4 HOUR > (SELECT max(ts) FROM events)")
def cache_lookup(spark, d):
    e = table(spark, d, "events")
    valid = e.join(F.broadcast(e.agg(F.max("ts").alias("as_of"))), F.col("ts") + F.expr("INTERVAL 4 HOURS") > F.col("as_of"))  # one row
    return valid.select("event_id", F.sha2(F.concat(F.lower(F.trim("event_type")), F.lit("|cot:"), F.when(F.col("user_id") % 2 == 0, "True").otherwise("False")), 256).alias("cache_key"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS hits FROM events")
def rate_window(spark, d):
    return A.window_counts(table(spark, d, "events"))


@query(
    """WITH r AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
f AS (SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM r)
SELECT event_id, failures, failures >= 5 AS locked FROM f"""
)
def lockout_state(spark, d):
    return A.failures_since_success(table(spark, d, "events"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, d):
    return E.windowed_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1␞', 'g'), '\\n', '␞', 'g'), '␞'), lambda s: trim(s, ' ')), lambda s: length(s) >= 10)"


@query(f"SELECT doc_id, CAST(len({_SENT}) AS INTEGER) AS sentences FROM documents")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query("SELECT source, count(*) FILTER (trim(text, ' ') = '' OR right(trim(text, ' '), 1) IN ('.', '!', '?', '\"', '''')) AS aligned, count(*) AS n FROM documents GROUP BY 1")
def boundary_alignment(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(T.sentence_aligned_end(F.col("text"))).alias("aligned"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH u AS (SELECT label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
s AS (SELECT label, pos, sum(x) AS t FROM u GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, n, round(CASE WHEN n <= 1 THEN 1.0 ELSE ((sum(t * t) - n) / (n * (n - 1.0)) + 1) / 2 END, 6) AS coherence FROM s JOIN n USING (label) GROUP BY label, n"""
)
def coherence_by_label(spark, d):
    e = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    flat = e.select("label", F.posexplode(F.transform("embedding", lambda v: v.cast("double") / norm)).alias("pos", "x"))
    s = flat.groupBy("label", "pos").agg(F.sum("x").alias("t"), F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.sum(F.col("t") * F.col("t")).alias("q"), F.max("n").alias("n"))
    return s.select("label", "n", F.round(F.when(F.col("n") <= 1, 1.0).otherwise(((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1.0)) + 1) / 2), 6).alias("coherence"))


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents) WHERE length(term) > 1 GROUP BY ALL")
def term_frequency(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("term")).where(F.length("term") > 1)
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    """WITH x AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'out_of_scope' WHEN 'click' THEN 'clause_lookup' ELSE 'regulation_search' END AS intent, user_id % 4 AS docs, value / 490 AS conf, user_id % 7 = 0 AS clarify FROM events)
SELECT event_id, CASE WHEN clarify THEN 'clarify' WHEN intent = 'out_of_scope' THEN 'copilot' WHEN intent = 'clause_lookup' AND docs > 0 THEN 'grounded' WHEN docs = 0 THEN 'refusal' WHEN conf >= 0.45 THEN 'grounded' ELSE 'copilot' END AS mode FROM x"""
)
def mode_decision(spark, d):
    kind = F.when(F.col("event_type") == "error", "out_of_scope").when(F.col("event_type") == "click", "clause_lookup").otherwise("regulation_search")
    return table(spark, d, "events").select("event_id", T.answer_mode(F.col("user_id") % 7 == 0, kind, F.col("user_id") % 4, F.col("value") / 490).alias("mode"))


@query("SELECT event_id, round(CASE WHEN value > 1 THEN value / 10 WHEN value <= 0.1 THEN least(value * 20, 1.0) ELSE value END, 9) AS critique, round(CASE WHEN value > 1 THEN least(value / 10, 1.0) WHEN value > 0 AND value <= 0.05 THEN least(greatest(value * 50, 0.1), 1.0) ELSE least(greatest(value, 0.0), 1.0) END, 9) AS answer FROM events")
def score_normalisers(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(T.critique_score(v), 9).alias("critique"), F.round(T.answer_score(v), 9).alias("answer"))


@query(
    """WITH x AS (SELECT doc_id, concat('FAR ', doc_id % 53, '.', doc_id % 700, ', DFARS 252.', doc_id % 300, '-', doc_id % 9, ' ', text) AS t FROM documents)
SELECT doc_id, array_to_string(list_concat(list_transform(regexp_extract_all(t, '\\bFAR\\s+(\\d+\\.\\d+(?:-\\d+)?)', 1), lambda c: 'FAR ' || c), list_transform(regexp_extract_all(t, '\\bDFARS\\s+(\\d+\\.\\d+(?:-\\d+)?)', 1), lambda c: 'DFARS ' || c)), ';') AS refs FROM x"""
)
def clause_references(spark, d):
    t = F.expr("concat('FAR ', doc_id % 53, '.', doc_id % 700, ', DFARS 252.', doc_id % 300, '-', doc_id % 9, ' ', text)")
    refs = F.array_join(F.transform(T.clause_references(t), lambda r: F.concat(r["type"], F.lit(" "), r["clause"])), ";")
    return table(spark, d, "documents").select("doc_id", refs.alias("refs"))


@query(
    f"""WITH x AS (SELECT doc_id, {_TOKENS.format(t='text')} AS n, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS alnum, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]')) AS shown,
  regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS w FROM documents)
SELECT doc_id FROM x WHERE n >= 8 AND alnum >= CAST(0.35 AS DOUBLE) * shown AND len(w) > 0 AND len(list_distinct(w)) >= CAST(0.08 AS DOUBLE) * len(w)"""
)
def quality_gate(spark, d):
    return table(spark, d, "documents").where(T.passes_quality_gate(F.col("text"))).select("doc_id")


@query("SELECT lang, source, count(*) AS n, max(doc_id) AS latest FROM documents GROUP BY 1, 2 ORDER BY latest DESC, lang, source LIMIT 20")
def recent_ingestions(spark, d):
    g = table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("latest"))
    return g.orderBy(F.desc("latest"), "lang", "source").limit(20)


@query(
    f"""WITH p AS (SELECT label, i AS j, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2),
q AS (SELECT label, list(x ORDER BY j) AS vector FROM p GROUP BY 1),
s AS (SELECT i.vec_id, q.label, {_COSINE} AS s FROM embeddings i, q)
SELECT vec_id, label AS nearest, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM s) WHERE r = 1"""
)
def centroid_nearest(spark, d):
    return C.nearest_centroid(table(spark, d, "embeddings"))


#: CTEs that end in z: the verdict on each question's dense hits
_CRITIQUED = """, h AS (SELECT dense.*, i.source, i.text FROM dense JOIN i USING (id)), a AS (SELECT q.query_id, q.query, i.source AS asked FROM q JOIN i ON i.id = q.query_id),
g AS (SELECT h.query_id, avg(CASE WHEN h.source = a.asked THEN 1.0 ELSE 0.0 END) AS aligned, arg_min(similarity, rank) AS raw, arg_min(text, rank) AS content FROM h JOIN a USING (query_id) WHERE rank <= 5 GROUP BY 1),
x AS (SELECT a.*, g.aligned, g.content, CASE WHEN coalesce(raw, 0) > 1 THEN raw / 10 WHEN coalesce(raw, 0) <= 0.1 THEN least(coalesce(raw, 0) * 20, 1.0) ELSE raw END AS score,
  list_filter(regexp_split_to_array(trim(lower(query), ' '), '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 3) AS words FROM a LEFT JOIN g USING (query_id)),
y AS (SELECT *, CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_filter(words, lambda w: contains(lower(content), w))) / len(words) END AS overlap FROM x),
z AS (SELECT *, CASE WHEN aligned IS NULL THEN 'none' WHEN asked IS NOT NULL AND aligned < 0.2 THEN 'mismatch' WHEN score >= 0.5 OR (score > 0.3 AND overlap > 0.6) THEN 'match' ELSE 'low' END AS reason FROM y)"""


@query(_BASE + _DENSE + _CRITIQUED + "SELECT query_id, reason = 'match' AS passed, round(score, 6) AS score, reason FROM z")
def critique(spark, d):
    index, asked = _index(spark, d), _asked(spark, d)
    found = R.dense_batch(index, asked).join(index.select("id", F.col("source").alias("regulation"), F.col("text").alias("content")), "id")
    q = asked.join(index.select(F.col("id").alias("query_id"), F.col("source").alias("regulation")), "query_id")
    return C.critique(found.withColumnRenamed("similarity", "score"), q)


@query(
    """WITH x AS (SELECT event_id, user_id % 5 AS docs, user_id % 11 = 0 AS mismatch, value / 1000 AS raw FROM events), y AS (SELECT *, CASE WHEN raw <= 0.1 THEN least(raw * 20, 1.0) ELSE raw END AS score FROM x)
SELECT event_id, docs = 0 OR mismatch OR docs < 3 OR (raw > 0 AND raw <= 0.05 AND score < 0.5) OR score < CAST(0.5 AS DOUBLE) - CAST(0.05 AS DOUBLE) AS heal FROM y"""
)
def heal_policy(spark, d):
    raw = F.col("value") / 1000
    score = F.when(raw <= 0.1, F.least(raw * 20, F.lit(1.0))).otherwise(raw)
    return table(spark, d, "events").select("event_id", T.should_heal(F.col("user_id") % 5, F.col("user_id") % 11 == 0, raw, score, 0.5).alias("heal"))


_CLAIMS = "list_filter(" + _SENT.replace(">= 10", ">= 30") + ", lambda s: NOT starts_with(s, '#') AND len(list_filter(regexp_split_to_array(s, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) >= 6)"


@query(
    f"""WITH c AS (SELECT doc_id, {_CLAIMS} AS claims FROM (SELECT doc_id, concat(text, '. The contractor must follow FAR 52.', doc_id % 300, ' in every such case.') AS text FROM documents))
SELECT doc_id, CAST(len(claims) AS INTEGER) AS claims, round(CASE WHEN len(claims) = 0 THEN 0.5 ELSE len(list_filter(claims, lambda s: regexp_matches(s, '{Q.CITATION}', 'i'))) / len(claims) END, 6) AS coverage FROM c"""
)
def citation_coverage(spark, d):
    t = F.expr("concat(text, '. The contractor must follow FAR 52.', doc_id % 300, ' in every such case.')")
    x = table(spark, d, "documents").select("doc_id", t.alias("text"))
    found = x.select("doc_id", Q.claims(F.col("text")).alias("c"))
    return found.select("doc_id", F.size("c").alias("claims"), F.round(Q.coverage_of(F.col("c")), 6).alias("coverage"))


_STOP = "[" + ", ".join(f"'{w}'" for w in Q.STOP_WORDS) + "]"
_CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({t}), '" + Q.CONTENT_WORD + "')), lambda w: NOT list_contains(" + _STOP + ", w))"


@query(
    f"""WITH x AS (SELECT item_id, {_CONTENT.replace('{t}', 'b.text')} AS a, {_CONTENT.replace('{t}', 'd.text')} AS s FROM benchmark b JOIN documents d ON b.item_id = d.doc_id)
SELECT item_id, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, s)) / len(a) END, 6) AS grounded FROM x"""
)
def groundedness(spark, d):
    b, t = table(spark, d, "benchmark").withColumnRenamed("text", "answer"), table(spark, d, "documents").select("doc_id", "text")
    return b.join(t, b["item_id"] == t["doc_id"]).select("item_id", F.round(Q.groundedness(F.col("answer"), F.col("text")), 6).alias("grounded"))


@query(
    """WITH x AS (SELECT event_id, user_id % 4 AS docs, value / 977 AS average, least(1.0, value / 491) AS top, CAST(user_id % 10 AS DOUBLE) / 10 AS grounded, CAST(event_id % 5 AS DOUBLE) / 5 AS coverage, event_id % 2 = 0 AS relaxed, event_id % 3 = 0 AS clause, event_type <> 'error' AS scope FROM events),
e AS (SELECT *, greatest(average, CAST(0.7 AS DOUBLE) * top + CAST(0.3 AS DOUBLE) * average) AS ev FROM x),
q AS (SELECT *, least(greatest(CAST(0.45 AS DOUBLE) * ev + CASE WHEN relaxed THEN CAST(0.35 AS DOUBLE) * grounded + CAST(0.2 AS DOUBLE) * coverage ELSE CAST(0.3 AS DOUBLE) * grounded + CAST(0.25 AS DOUBLE) * coverage END, 0.0), 1.0) AS quality FROM e),
c AS (SELECT *, least(greatest(CAST(0.45 AS DOUBLE) * ev + CAST(0.25 AS DOUBLE) * grounded + CAST(0.2 AS DOUBLE) * coverage + CAST(0.1 AS DOUBLE) * quality, 0.0), 1.0) AS confidence FROM q),
l AS (SELECT *, docs < CASE WHEN clause THEN 1 ELSE 2 END OR (confidence < 0.3 AND average < 0.35) AS low FROM c)
SELECT event_id, round(quality, 4) AS quality, round(confidence, 4) AS confidence, low AS low_confidence, docs <= 0 OR (scope AND low AND confidence < 0.25) AS show_banner FROM l"""
)
def answer_quality(spark, d):
    e = table(spark, d, "events").where("value is not null")
    top = F.least(F.lit(1.0), F.col("value") / 491)
    of = Q.answer_quality(F.col("user_id") % 4, F.col("value") / 977, top, (F.col("user_id") % 10) / 10, (F.col("event_id") % 5) / 5, F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.col("event_type") != "error")
    return e.select("event_id", of.alias("a")).select("event_id", "a.*")


_REG = "CASE WHEN regexp_matches({r}, '^EM[\\s\\-]*385$') THEN 'EM385' ELSE {r} END"


@query(
    f"""WITH x AS (SELECT item_id, ['FAR 52.236-2 ', 'the dfars says ', 'EM 385-1-1 on ', ''][item_id % 4 + 1] || text AS q FROM benchmark),
y AS (SELECT item_id, regexp_extract(q, '{I.CLAUSE}', 2, 'i') AS clause, upper(regexp_extract(q, '{I.CLAUSE}', 1, 'i')) AS r, upper(regexp_extract(q, '{I.SOURCE}', 1, 'i')) AS s FROM x)
SELECT item_id, CASE WHEN clause <> '' THEN 'clause_lookup' WHEN s <> '' THEN 'regulation_search' ELSE 'out_of_scope' END AS intent, CASE WHEN clause <> '' THEN 1.0 WHEN s <> '' THEN 0.8 ELSE 0.0 END AS confidence,
  CASE WHEN clause <> '' THEN {_REG.format(r='r')} WHEN s <> '' THEN {_REG.format(r='s')} END AS regulation, CASE WHEN clause <> '' THEN clause END AS clause FROM y"""
)
def intent_by_wording(spark, d):
    start = F.element_at(F.array(*map(F.lit, ("FAR 52.236-2 ", "the dfars says ", "EM 385-1-1 on ", ""))), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", I.intent(F.concat(start, F.col("text"))).alias("i")).select("item_id", "i.*")


@query(
    _BASE
    + _DENSE
    + """, w AS (SELECT DISTINCT query_id, source FROM dense JOIN i USING (id) WHERE rank <= 8)
SELECT * FROM (SELECT query_id, i.id, row_number() OVER (PARTITION BY query_id ORDER BY i.id) AS rank FROM w JOIN i USING (source) WHERE i.id % 10 = 0) WHERE rank <= 25"""
)
def anchor_lookup(spark, d):
    index = _index(spark, d).select("*", F.col("source").alias("section"), (F.col("id") % 10 == 0).alias("is_anchor"))
    return C.anchors(R.dense_batch(index, _asked(spark, d)).join(index.select("id", "section"), "id"), index)


@query(
    _BASE
    + _DENSE
    + """, r AS (SELECT q.query_id, i.source, w.clause FROM q JOIN i ON i.id = q.query_id, (VALUES ('tion'), ('en')) w(clause)),
f AS (SELECT r.query_id, r.source, r.clause, i.id FROM r JOIN i USING (source) WHERE contains(lower(i.text), r.clause) AND NOT EXISTS (SELECT 1 FROM dense h WHERE h.query_id = r.query_id AND h.id = i.id)),
e AS (SELECT DISTINCT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, clause ORDER BY id) AS n FROM f) WHERE n <= 5)
SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM e) WHERE rank <= 20"""
)
def reference_expansion(spark, d):
    index, asked = _index(spark, d).withColumn("section", F.lit("")), _asked(spark, d)
    refs = asked.join(index.select(F.col("id").alias("query_id"), "source"), "query_id").select("query_id", "source", F.explode(F.array(F.lit("tion"), F.lit("en"))).alias("clause"))
    return C.expand_references(refs, index, R.dense_batch(index, asked))


_HEADS = ("PART 5 ", "Subpart 5.2 ", "52.236-2 ", "", "", "APPENDIX A ", "A-1 ", "")
_LINES = f"""WITH l AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
h AS (SELECT doc_id, pos, trim({list(_HEADS)!r}[(doc_id + pos) % 8 + 1] || t, ' ') AS line FROM l),
k AS (SELECT *, CASE WHEN line = '' THEN 'EMPTY' WHEN regexp_matches(line, '{S.FOOTER}') THEN 'FOOTER' {' '.join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in S.REGULATION_LINES)} ELSE 'BODY' END AS kind FROM h)"""


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """The documents as FAR texts, with headings before some of their lines."""
    head = lambda i: F.element_at(F.array(*map(F.lit, _HEADS)), ((F.col("doc_id") + i) % 8 + 1).cast("int"))
    text = F.array_join(F.transform(F.split("text", "\n"), lambda t, i: F.concat(head(i), t)), "\n")
    return table(spark, d, "documents").select("doc_id", F.lit("FAR").alias("source"), text.alias("text"))


@query(_LINES + " SELECT kind, count(*) AS n FROM k GROUP BY 1")
def line_classes(spark, d):
    return S.lines(_headed(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    _LINES
    + """, c AS (SELECT doc_id, pos, line, kind, sum(CASE WHEN kind IN ('SECTION', 'APPENDIX_SECTION') THEN 1 ELSE 0 END) OVER w AS section, last_value(CASE WHEN kind = 'PART' THEN line END IGNORE NULLS) OVER w AS pt, coalesce(max(CASE WHEN kind = 'PART' THEN pos END) OVER w, -1) AS pp,
  last_value(CASE WHEN kind = 'SUBPART' THEN line END IGNORE NULLS) OVER w AS st, coalesce(max(CASE WHEN kind = 'SUBPART' THEN pos END) OVER w, -1) AS sp, coalesce(max(CASE WHEN kind = 'APPENDIX' THEN pos END) OVER w, -1) AS ap
  FROM k WHERE kind NOT IN ('EMPTY', 'FOOTER') WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, CAST(section AS BIGINT) AS section, md5(arg_min(line, pos)) AS heading, md5(first(CASE WHEN pp > ap THEN pt END ORDER BY pos)) AS part, md5(first(CASE WHEN sp > greatest(pp, ap) THEN st END ORDER BY pos)) AS subpart, count(*) AS n_lines
FROM c WHERE section > 0 AND kind IN ('SECTION', 'APPENDIX_SECTION', 'BODY') GROUP BY doc_id, section"""
)
def structured_sections(spark, d):
    s = S.sections(S.lines(_headed(spark, d)))
    return s.select("doc_id", "section", *(F.md5(c).alias(c) for c in ("heading", "part", "subpart")), "n_lines")


_OPENINGS = (
    "FAR 52.236-2 ", "what is the delay with UXO and ", "draft a letter on ", "is the document generator down ", "the dfars says ", "how often do i send ",
    "inspection checklist ", "REA vs change order ", "commissioning of ", "concurrent delay and schedule risk ", "What does the vendor say ", "apartment contact ",
)
_Q = f"trim(regexp_replace({_pick(_OPENINGS, 'item_id')} || text, '\\s+', ' ', 'g'), ' ')"


def _has(pattern: str, q: str = "q") -> str:
    return f"regexp_matches({q}, '" + pattern.replace("'", "''") + "', 'i')"


_HAZARD = " OR ".join("(" + " AND ".join(_has(w) for w in words) + ")" for words in K.hazard_patterns())
_KEYS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_has(K.keyword_pattern(k))} THEN '{k}' END" for k in K.KEYWORDS) + "], lambda x: x IS NOT NULL), ';')"


#: CTEs that classify x(q, ...): all its columns with intent, confidence, clause_reference, regulation, keywords, document_type and flags
_CLASSIFIED = f"""y AS (SELECT *, regexp_extract(q, '{I.CLAUSE}', 2, 'i') AS c, upper(regexp_extract(q, '{I.CLAUSE}', 1, 'i')) AS r, upper(regexp_extract(q, '{I.SOURCE}', 1, 'i')) AS s, {_KEYS} AS kw, {_HAZARD} AS safe FROM x),
z AS (SELECT *, CASE WHEN c <> '' THEN 'clause' WHEN {_has(K.PRODUCT)} AND kw = '' AND s = '' THEN 'product' WHEN s <> '' THEN 'source' WHEN kw <> '' THEN 'keyword'
  WHEN {_has(K.QUESTION)} AND {_has(K.HOOK)} THEN 'frame' WHEN safe THEN 'safety' ELSE 'none' END AS layer FROM y),
classified AS (SELECT * EXCLUDE (c, r, s, kw, safe, layer), CASE WHEN layer = 'clause' THEN 'clause_lookup' WHEN layer IN ('product', 'none') THEN 'out_of_scope' ELSE 'regulation_search' END AS intent,
  CASE layer WHEN 'clause' THEN 1.0 WHEN 'source' THEN 0.8 WHEN 'keyword' THEN 0.6 WHEN 'frame' THEN 0.55 WHEN 'safety' THEN 0.55 ELSE 0.0 END AS confidence,
  CASE WHEN layer = 'clause' THEN {_REG.format(r='r')} || ' ' || regexp_replace(c, '-+$', '') END AS clause_reference,
  CASE WHEN layer = 'clause' THEN {_REG.format(r='r')} WHEN layer = 'source' THEN {_REG.format(r='s')} WHEN layer IN ('keyword', 'frame') AND {_has(K.HINT)} THEN 'FAR' END AS regulation,
  CASE WHEN layer = 'keyword' THEN kw ELSE '' END AS keywords,
  CASE WHEN layer = 'product' THEN NULL WHEN {_has(K.CHECKLIST)} THEN 'checklist' WHEN {_has(K.FORM)} THEN 'form' WHEN {_has(K.AMENDMENT)} OR {_has(K.LETTER)} THEN 'letter' END AS document_type,
  {_has(K.PROCEDURAL)} AND layer NOT IN ('product', 'safety', 'none') AS is_procedural, {_has(K.FREQUENCY)} AND layer NOT IN ('product', 'safety', 'none') AS is_contract_co,
  {_has(K.COMPARISON)} AND layer <> 'product' AS is_comparison, {_has(K.LIFECYCLE)} AND layer <> 'product' AS is_construction_lifecycle,
  {_has(K.SCHEDULE)} AND {_has(K.RISK)} AND layer <> 'product' AS is_schedule_risk, safe AND layer <> 'product' AS is_safety_critical FROM z)"""


@query(f"WITH x AS (SELECT item_id, {_Q} AS q FROM benchmark), {_CLASSIFIED} SELECT * EXCLUDE (q) FROM classified")
def intent_waterfall(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", F.concat(_picked(_OPENINGS, "item_id"), F.col("text")).alias("question"))
    return K.classify(asked).drop("question").withColumn("keywords", F.array_join("keywords", ";"))


@query()
def unwrapped_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(H.unwrapped(F.col("text"), F.lit("FAR"))).alias("text"))


@query()
def section_chunks(spark, d):
    """Chunks of the headed documents' sections that are worth storing."""
    found = S.sections(S.lines(_headed(spark, d))).withColumn("source", F.lit("FAR"))
    return H.stored(H.chunk_sections(found)).withColumn("text", F.md5("text"))


_HITS = (
    _BASE + _DENSE + _LEXICAL + _FUSED + """,
h AS (SELECT query_id, id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score * CASE WHEN in_dense = 1 AND in_lexical = 0 THEN 1.05 ELSE 1.0 END, 9) DESC, id) AS rank FROM fused QUALIFY rank <= 10)"""
)


@query(
    _HITS + f""", w AS (SELECT DISTINCT query_id, source FROM h JOIN documents d ON h.id = d.doc_id WHERE rank <= 8),
a AS (SELECT query_id, d.doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY d.doc_id) AS rank FROM w JOIN documents d USING (source) WHERE d.doc_id % 10 = 0 QUALIFY rank <= 25),
r AS (SELECT b.item_id AS query_id, d.source, c.clause FROM benchmark b JOIN documents d ON b.item_id = d.doc_id, (VALUES ('tion'), ('en')) c(clause)),
f AS (SELECT r.query_id, r.source, r.clause, d.doc_id AS id FROM r JOIN documents d USING (source) WHERE contains(lower(d.text), r.clause) AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = r.query_id AND h.id = d.doc_id)),
e AS (SELECT DISTINCT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, clause ORDER BY id) AS n FROM f) WHERE n <= 5),
g AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM e QUALIFY rank <= 4),
l AS (SELECT query_id, id, 0 AS kind, rank FROM h UNION ALL SELECT query_id, id, 1, rank FROM a UNION ALL SELECT query_id, id, 2, rank FROM g),
o AS (SELECT l.*, {_TOKENS.format(t='d.text')} AS n FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY kind, rank) = 1) l JOIN documents d ON d.doc_id = l.id),
p AS (SELECT query_id, list_reduce(list_transform(list(struct_pack(n := n, id := id) ORDER BY kind, rank, id), lambda x: struct_pack(used := CAST(CASE WHEN x.n <= 2400 THEN x.n ELSE 0 END AS BIGINT), n := CAST(x.n AS BIGINT), ids := CASE WHEN x.n <= 2400 THEN [x.id] ELSE [] END)),
  lambda s, x: CASE WHEN s.used + x.n <= 2400 THEN struct_pack(used := s.used + x.n, n := x.n, ids := list_concat(s.ids, x.ids)) ELSE s END) AS s FROM o GROUP BY 1)
SELECT query_id, CAST(s.used AS BIGINT) AS used, array_to_string(s.ids, ',') AS ids FROM p WHERE len(s.ids) > 0"""
)
def search_regulations(spark, d):
    """The flagship: hits of both legs, anchors of their sections and referred chunks, as one context a query."""
    docs = _texts(spark, d)
    index = docs.select("id", "source", "text", F.col("source").alias("section"), (F.col("id") % 10 == 0).alias("is_anchor"))
    hits = written(hybrid_boosted(spark, d))
    placed = hits.join(index.select("id", "section"), "id")
    words = F.explode(F.array(F.lit("tion"), F.lit("en"))).alias("clause")
    refs = _questions(spark, d).join(docs.select(F.col("id").alias("query_id"), "source"), "query_id").select("query_id", "source", words)
    referred = C.expand_references(refs, index.withColumn("section", F.lit("")), hits)
    got = X.context(hits, C.anchors(placed, index), referred, docs)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"].cast("string")), ",")
    return got.groupBy("query_id").agg(F.sum("tokens").alias("used"), ids.alias("ids"))


@query(
    _HITS + r""", q0 AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'FAR 52.' || (item_id % 7) WHEN 1 THEN 'EM 385 1-9' ELSE 'no clause' END AS query FROM benchmark),
ix AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'FAR' ELSE 'EM385' END AS source, lower(text || ' 52.' || (doc_id % 9) || ' ') AS t FROM documents),
r AS (SELECT query_id, upper(regexp_replace(regexp_extract(query, '(?i)(FAR|DFARS|EM\s*385)\s*([\d]+[.\-][\d\-]+)', 1), '\s+', '', 'g')) AS source, regexp_extract(query, '(?i)(FAR|DFARS|EM\s*385)\s*([\d]+[.\-][\d\-]+)', 2) AS clause FROM q0),
x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY strpos(t, clause), id) AS rank FROM r JOIN ix USING (source) WHERE clause <> '' AND strpos(t, clause) > 0 QUALIFY rank <= 10)
SELECT query_id, id, rank, true AS found, 1.0 AS confidence FROM x UNION ALL SELECT query_id, id, rank, false, rrf_score FROM h WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM x)"""
)
def clause_by_reference(spark, d):
    b = table(spark, d, "benchmark")
    text = F.expr("case item_id % 3 when 0 then 'FAR 52.' || (item_id % 7) when 1 then 'EM 385 1-9' else 'no clause' end")
    index = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("if(doc_id % 2 = 0, 'FAR', 'EM385')").alias("source"), F.expr("text || ' 52.' || (doc_id % 9) || ' '").alias("text"))
    return X.clause_lookup(index, b.select(F.col("item_id").alias("query_id"), text.alias("query")), hybrid_boosted(spark, d))
