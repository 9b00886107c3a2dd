"""Audit of how far the sources of a language differ in their words, in plain relational steps.

Method. Texts are cut into terms by one pattern and exploded, with a mark at a term's first place in its document, so
one grouping by (lang, source, term) counts occurrences and documents with map-side sums. Terms in enough documents of
a language are its vocabulary; every group of the language is joined with it, which makes the zeros, and zeros and
counts are summed by (lang, term, group). A self-join on (lang, term) holds two groups' shares against each other
in both directions at once; sums and ranks follow.

Scale. A language may hold most rows: the vocabulary meets the groups on (lang, salt), groups being one small row each
for every salt. The self-join's keys have one row a source, never more. The rank of terms has a limit, so Spark keeps no
more than that many rows a group and task before it shuffles. Counts are multiplied as decimals: no overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.llm.common import Workspace, partitions

#: what stands between terms; a term is a run of [^\x00-\x40\x5B-\x60\x7B-\x7F]
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, SMOOTH, LEAST_DOCS, TOP = 1_000_000_000, 1, 3, 200


def terms(text: Column) -> Column:
    """The terms of a text, in order; only A-Z are lower-cased."""
    plain = F.octet_length(text) == F.char_length(text)  # lower() has a quick way for ASCII alone
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), GAP), "")


def share(count: str, total: str, size: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * size)), exactly."""
    wide = f"(cast({SCALE} as decimal(10, 0)) * cast({count} + {SMOOTH} as decimal(20, 0))) div cast({total} + {SMOOTH} * {size} as decimal(20, 0))"
    return F.expr(f"1 + if({count} < {9 * SCALE}, ({SCALE}L * ({count} + {SMOOTH})) div ({total} + {SMOOTH} * {size}), {wide})")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def counts_by_group(docs: DataFrame) -> DataFrame:
    """g, term, n (occurrences), docs (rows of docs(g, text) that hold the term)."""
    found = docs.select("g", terms(F.col("text")).alias("t"))
    # occurrences, then each term of the document once more; an outer explode, for the plain one cuts every text twice
    each = found.select("g", F.size("t").alias("size"), F.posexplode_outer(F.concat("t", F.array_distinct("t"))).alias("place", "term")).where("term is not null")
    sums = each.groupBy("g", "term").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("place") >= F.col("size")).cast("long")).alias("docs"))
    return sums.select("g", "term", (F.col("n") - F.col("docs")).alias("n"), "docs")


def shares(docs: DataFrame, work: Workspace, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups: lang, source, g, their number; dense: lang, term, g, p for every group of a language and kept term;
    used: lang, source, term, p of the group, q of the language, where the group has the term)."""
    salts = partitions(docs.sparkSession)
    groups = work.save(docs.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()))
    counts = work.save(counts_by_group(docs.join(groups, ["lang", "source"])))
    counts = counts.join(groups.select("g", "lang"), "g")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("d")).where(F.col("d") >= least_docs).select("lang", "term", "in_lang")
    vocabulary = work.save(kept)
    own = work.save(counts.join(vocabulary, ["lang", "term"]).where("n > 0").select("lang", "g", "term", "n", "in_lang"))
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("all_lang"))
    totals = own.groupBy("g").agg(F.sum("n").alias("total"))
    known = groups.join(sizes, "lang").join(totals, "g", "left").select("lang", "source", "g", F.coalesce("total", F.lit(0)).alias("total"), "v", "all_lang")
    # a row a group and salt: wherever a large side meets the groups, a language or a group is dealt by salts
    known = work.save(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    salt = F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt")
    zeros = vocabulary.select("lang", "term", salt).join(known.select("lang", "salt", "g"), ["lang", "salt"]).select("lang", "term", "g", F.lit(0).cast("long").alias("n"))
    rows = zeros.unionByName(own.select("lang", "term", "g", "n")).repartition(salts, "lang", "term")
    filled = rows.groupBy("lang", "term", "g").agg(F.sum("n").alias("n"))
    dense = filled.select("*", salt).join(known.select("g", "salt", "total", "v"), ["g", "salt"]).select("lang", "term", "g", share("n", "total", "v").alias("p"))
    used = own.select("g", "term", "n", "in_lang", salt).join(known, ["g", "salt"]).select("lang", "source", "term", share("n", "total", "v").alias("p"), share("in_lang", "all_lang", "v").alias("q"))
    return groups, work.save(dense), used


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for docs(text, lang, source).

    Part 'pair': every other source of the language, farthest first. Part 'term': the terms that a source uses more than
    its language does, at most top. Null text, lang and source count as ''; every row is a document, so repeated rows
    count again; texts without a term (empty ones too) still make their group; a language without kept terms has
    pairs of value 0; a language of one source has no pair. An empty table has no rows. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "divergence")
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups, dense, used = shares(plain, work, least_docs)

    one, other = (dense.select("lang", "term", F.col("g").alias(g), F.col("p").alias(p)) for g, p in (("a", "pa"), ("b", "pb")))
    both = one.join(other, ["lang", "term"]).where("a < b").groupBy("a", "b").agg(F.sum(distance("pa", "pb")).alias("ab"), F.sum(distance("pb", "pa")).alias("ba"))
    ways = (F.struct(F.col(x).alias("g"), F.col(y).alias("other"), F.col(x + y).alias("value")) for x, y in ("ab", "ba"))
    sums = both.select(F.explode(F.array(*ways)).alias("x")).select("x.*")
    pairs = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("other")), "lang").where("g <> other")
    pairs = pairs.join(sums, ["g", "other"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    marked = used.where("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    ranked = ranked.unionByName(marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
vocab AS (SELECT lang, term, count(*) AS m FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
own AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN vocab USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
size AS (SELECT lang, count(*) AS v, sum(m) AS a FROM vocab GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS t FROM own GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (coalesce(t.t, 0) + s.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.m + 1)) // (s.a + s.v)::HUGEINT AS q
  FROM groups g JOIN vocab k ON k.lang = g.lang JOIN size s ON s.lang = g.lang
  LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
"""
