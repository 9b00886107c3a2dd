"""Queries of the lexical search with English stems, and SQL that states the same, the stemmer's rules included."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexilake.functions import stem as S
from lexilake.functions import text as T
from lexilake.operators import lexical as L
from lexilake.operators import retrieval as R
from lexilake.plans.registry import _BASE, _COSINE, _asked, _index, _questions, _texts, query
from lexilake.session import table

_V, _C = "[aeiouy]", "[^aeiouy]"
_SHORT = f"((^|{_C}){_V}[^aeiouywxY]|^{_V}{_C})$"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _endings(endings, start: str, allowed: dict[str, str]) -> str:
    """CASE over endings, the first that the word has: replaced if it lies beyond start and its rest is allowed."""
    rest = lambda e: f"left(w, length(w) - {len(e)})"
    when = lambda e, to: f"WHEN ends_with(w, '{e}') THEN CASE WHEN length(w) - {len(e)} >= {start} AND {allowed.get(e, 'true').replace('rest', rest(e))} THEN {rest(e)} || '{to}' ELSE w END"
    return "CASE " + " ".join(when(e, to) for e, to in endings) + " ELSE w END"


def stems_sql(words: str) -> str:
    """CTEs that end in stems(word, term) for the distinct words of the relation `words` that are no stop words."""
    keep = "word, r1, r2"
    return rf"""
s0 AS (SELECT DISTINCT word FROM {words} WHERE word NOT IN ({_quoted(T.ENGLISH_STOP_WORDS)})),
s1 AS (SELECT word, regexp_replace(CASE WHEN starts_with(word, 'y') THEN 'Y' || substr(word, 2) ELSE word END, '({_V})y', '\1Y', 'g') AS w FROM s0),
s2 AS (SELECT word, w, CASE WHEN regexp_matches(w, '{_V}{_C}') THEN length(regexp_extract(w, '^(?:{'|'.join(S.BEGINNINGS)}|{_C}*{_V}+{_C})')) ELSE length(w) END AS r1 FROM s1),
s3 AS (SELECT word, w, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '{_V}{_C}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^{_C}*{_V}+{_C}')) ELSE length(w) END AS r2 FROM s2),
s4 AS (SELECT {keep}, CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
  WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
  WHEN regexp_matches(w, '[us]s$') OR NOT ends_with(w, 's') THEN w
  WHEN regexp_matches(left(w, greatest(length(w) - 2, 0)), '{_V}') THEN left(w, length(w) - 1) ELSE w END AS w FROM s3),
s5 AS (SELECT {keep}, w, w IN ({_quoted(S.LEFT_ALONE)}) AS done, regexp_replace(w, '(ingly|edly|ing|ed)$', '') AS rest FROM s4),
s6 AS (SELECT {keep}, done, w AS before, CASE
  WHEN ends_with(w, 'eedly') THEN CASE WHEN length(w) - 5 >= r1 THEN left(w, length(w) - 5) || 'ee' ELSE w END
  WHEN ends_with(w, 'eed') THEN CASE WHEN length(w) - 3 >= r1 THEN left(w, length(w) - 3) || 'ee' ELSE w END
  WHEN rest = w OR NOT regexp_matches(rest, '{_V}') THEN w
  WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e'
  WHEN regexp_matches(rest, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(rest, length(rest) - 1)
  WHEN length(rest) <= r1 AND regexp_matches(rest, '{_SHORT}') THEN rest || 'e' ELSE rest END AS w FROM s5),
s7 AS (SELECT {keep}, done, before, CASE WHEN length(w) > 2 AND regexp_matches(w, '{_C}[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM s6),
s8 AS (SELECT {keep}, done, before, {_endings(S.STEP_2, 'r1', {'ogi': "ends_with(rest, 'l')", 'li': "regexp_matches(rest, '[cdeghkmnrt]$')"})} AS w FROM s7),
s9 AS (SELECT {keep}, done, before, {_endings(S.STEP_3, 'r1', {'ative': 'length(w) - 5 >= r2'})} AS w FROM s8),
s10 AS (SELECT {keep}, done, before, {_endings([(e, '') for e in S.STEP_4], 'r2', {'ion': "regexp_matches(rest, '[st]$')"})} AS w FROM s9),
s11 AS (SELECT word, done, before, CASE WHEN ends_with(w, 'e') AND (length(w) > r2 OR (length(w) > r1 AND NOT regexp_matches(left(w, length(w) - 1), '{_SHORT}'))) THEN left(w, length(w) - 1)
  WHEN ends_with(w, 'll') AND length(w) > r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM s10),
stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word {' '.join(f"WHEN word = '{a}' THEN '{b}'" for a, b in S.IRREGULAR.items())}
  ELSE replace(CASE WHEN done THEN before ELSE w END, 'Y', 'y') END AS term FROM s11)"""


_CUT = r"unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}]+')) AS word"
_WORDS = f"dw AS (SELECT doc_id AS id, {_CUT.format(text='text')} FROM documents), qw AS (SELECT item_id AS query_id, {_CUT.format(text='text')} FROM benchmark), aw AS (SELECT word FROM dw UNION ALL SELECT word FROM qw),"


def _top(k: int, where: str = "") -> str:
    """CTE lexical: the first k documents of every query by stems, of the documents that `where` keeps."""
    return f""", lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(count(*) / (count(*) + 1), 6) AS score FROM (SELECT id, term FROM dw JOIN stems USING (word)) p
  JOIN (SELECT DISTINCT query_id, term FROM qw JOIN stems USING (word)) t USING (term) {where} GROUP BY ALL)) WHERE rank <= {k})"""


@query("WITH " + _WORDS + stems_sql("aw") + _top(10) + "SELECT query_id, id, score, rank FROM lexical")
def stemmed_topk(spark, d):
    return L.search(_texts(spark, d), _questions(spark, d))


_PLACED = r"unnest(range(1, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) + 1)) AS place"


@query(
    f"WITH dl AS (SELECT doc_id AS id, {_PLACED}, {_CUT.format(text='text')} FROM documents),"
    + stems_sql("dl")
    + """
SELECT id AS doc_id, term, count(*) AS f, array_to_string(list(place ORDER BY place), ',') AS positions FROM dl JOIN stems USING (word) GROUP BY ALL"""
)
def lexeme_positions(spark, d):
    return L.lexemes(_texts(spark, d)).select(F.col("id").alias("doc_id"), "term", F.col("f").cast("long").alias("f"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(f"WITH aw AS (SELECT {_CUT.format(text='text')} FROM documents)," + stems_sql("aw") + "SELECT word, term FROM stems")
def word_stems(spark, d):
    words = table(spark, d, "documents").select(F.explode_outer(L.words_in(F.col("text"))).alias("word")).distinct()
    return words.where(~F.col("word").isin(T.ENGLISH_STOP_WORDS)).select("word", S.stem_words(F.col("word")).alias("term"))


@query(
    _BASE.replace("ON d.doc_id = e.vec_id)", "ON d.doc_id = e.vec_id WHERE d.lang = 'en' AND d.source = 'src3')", 1)
    + f""", dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
  FROM (SELECT q.query_id, i.id, {_COSINE} AS similarity FROM i, q)) WHERE rank <= 20),
dw AS (SELECT id, {_CUT.format(text='text')} FROM i), qw AS (SELECT query_id, {_CUT.format(text='query')} FROM q), aw AS (SELECT word FROM dw UNION ALL SELECT word FROM qw),"""
    + stems_sql("aw") + _top(20)
    + """, fused AS (SELECT query_id, id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 9) AS rrf_score, max(d) AS in_dense, max(l) AS in_lexical FROM (
  SELECT query_id, id, rank, 1 AS d, 0 AS l FROM dense UNION ALL SELECT query_id, id, rank, 0, 1 FROM lexical) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank FROM (
  SELECT *, round(rrf_score * CASE WHEN in_dense = 1 AND in_lexical = 0 THEN 1.05 ELSE 1.0 END, 9) AS final_score FROM fused)) WHERE rank <= 10"""
)
def hybrid_filtered(spark, d):
    """Both legs within the namespace 'en' and the source 'src3'."""
    index = _index(spark, d).withColumn("key", F.concat_ws(":", "lang", "id"))
    return R.hybrid_search(index, _asked(spark, d), 10, namespace="en", source="src3", key="key")
