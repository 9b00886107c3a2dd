"""Lexical search: places of stems in documents, and an exact top k.

Queries of few words in all (COUNTED pairs of a query and a term) are known to every task: it counts their terms in its
documents, sums the counts by query and keeps the k best documents, so that no words leave their task. More queries, and
rows of an id that repeats, meet by postings: a document's score for a query grows with the sum f of its counts of the query's terms. The k documents with most
of each single term give k sums that the answer can't fall below (theta). A document whose counts all stay
under theta * max(term) / sum of max(terms) can't reach theta, so only postings above that bound give candidates, and
only candidates are summed. Nothing is cut that could be in the answer, ties included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lexilake.functions import stem as S
from lexilake.functions import text as T
from lexilake.session import bounded_batches, written

#: pairs of a query and a term that tasks hold, and those of a document and a query, or links to such, that they sum at once
COUNTED, SUMMED = 1 << 18, 1 << 20
#: what stands between words; explodes are outer ones, for Spark cuts the texts twice to leave out empty arrays before plain ones
GAP = r"[^\p{L}\p{N}]+"


def filtered(index: DataFrame, namespace: str | None = None, source: str | None = None, key: str = "id") -> DataFrame:
    """The rows of a namespace (keys that begin with it and a colon) and of a source; None lets all through."""
    if namespace is not None:
        index = index.where(F.startswith(F.col(key).cast("string"), F.lit(f"{namespace}:")))
    return index if source is None else index.where(F.col("source") == source)


def words_in(text: Column) -> Column:
    """Words of letters and digits, lower-cased, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def by_ids(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id no other row has, those of ids that repeat or None if there are none); a null id counts as one.

    Only ids are shuffled, and few repeated ones are broadcast.
    """
    several = written(rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("several")))
    if several.isEmpty():
        return rows, None
    same = rows["id"].eqNullSafe(several["several"])
    return rows.join(several, same, "left_anti"), rows.join(several, same, "left_semi")


def _places(batches):
    """id, term, positions of each term in each row of batches(id, words)."""
    stop = set(T.ENGLISH_STOP_WORDS)
    for b in batches:
        lists = b.column(1)
        coded = lists.flatten().dictionary_encode()
        number: dict[str, int] = {}
        of_word = np.array([-1 if w in stop else number.setdefault(S.stem(w), len(number)) for w in coded.dictionary.to_pylist()], np.int64)
        size = lists.value_lengths().to_numpy()
        row, place = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
        term = of_word[coded.indices.to_numpy()] if len(row) else np.zeros(0, np.int64)
        kept = np.flatnonzero(term >= 0)
        key = row[kept] * len(number) + term[kept]
        order = np.argsort(key, kind="stable")
        kept, key = kept[order], key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[kept], pa.int32()))
        at = kept[first]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[at])), pa.array(list(number), pa.string()).take(pa.array(term[at])), positions], ["id", "term", "positions"])


def lexemes(texts: DataFrame) -> DataFrame:
    """id, term, f, positions for texts(id, text): stems without English stop words; positions count all words from 1.

    A row's words stay in its task; only rows of an id that repeats are grouped.
    """
    bounded_batches(texts.sparkSession)
    out = StructType([StructField("id", texts.schema["id"].dataType), StructField("term", StringType()), StructField("positions", ArrayType(IntegerType()))])
    once, several = (x if x is None else x.select("id", words_in(F.col("text")).alias("words")).mapInArrow(_places, out) for x in by_ids(texts.select("id", "text")))
    if several is not None:
        once = once.unionByName(several.groupBy("id", "term").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")))
    return once.select("id", "term", F.size("positions").alias("f"), "positions")


def _stemmed(words: DataFrame) -> DataFrame:
    """word, term of the distinct words of words(word) that are no stop words; few bytes, but work for many tasks."""
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.where(~F.col("word").isin(T.ENGLISH_STOP_WORDS)).distinct().repartition(tasks, "word").select("word", S.stem_words(F.col("word")).alias("term"))


def _cut(text: Column, stems: bool) -> Column:
    """The words that terms are made of, with what is left over between them."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), GAP) if stems else F.split(F.lower(text), "[^a-z0-9]+")


def asked_terms(queries: DataFrame, stems: bool) -> DataFrame:
    """query_id, term: the distinct terms of queries(query_id, query), as a table."""
    words = queries.select("query_id", F.explode_outer(_cut(F.col("query"), stems)).alias("word")).where("word <> ''")
    if stems:
        return written(words.join(_stemmed(words.select("word")), "word").select("query_id", "term").distinct())
    return written(words.select("query_id", F.col("word").alias("term")).where(F.length("term") > 1).distinct())


def stem_postings(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings id, term, f; asked query_id, term) in stems, of the terms that are asked for alone.

    Stems are made of distinct words; only words of a stem that is asked for leave their documents.
    """
    asked = asked_terms(queries, True)
    return _stem_postings(index, asked), asked


def _stem_postings(index: DataFrame, asked: DataFrame) -> DataFrame:
    each = index.select("id", F.explode_outer(words_in(F.col("text"))).alias("word"))
    known = _stemmed(each.select("word")).join(asked.select("term").distinct(), "term", "left_semi")
    return each.join(written(known), "word").groupBy("id", "term").agg(F.count(F.lit(1)).alias("f"))


def _plain_postings(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The same with words of at least two letters and digits of ASCII as terms, stop words among them."""
    each = index.select("id", F.explode_outer(_cut(F.col("text"), False)).alias("term"))
    return each.join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "term").agg(F.count(F.lit(1)).alias("f"))


def _sums(pairs: DataFrame, postings: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, id, f of pairs(query_id, id), summed over all of the query's terms."""
    return pairs.join(asked, "query_id").join(postings, ["id", "term"]).groupBy("query_id", "id").agg(F.sum("f").alias("f"))


def candidates(postings: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The distinct (query_id, id) that can be among a query's first k."""
    most = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("f"), "id"))  # k a term and task before the shuffle
    seeds = asked.join(postings.withColumn("n", most).where(F.col("n") <= k), "term").select("query_id", "id").distinct()
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("f")))
    found = _sums(seeds, postings, asked).withColumn("n", nth).where(F.col("n") <= k).groupBy("query_id").agg(F.min("f").alias("f"), F.count(F.lit(1)).alias("n"))
    # scores are rounded: the least sum that can still tie with theta's
    low = F.round(F.col("f") / (F.col("f") + 1), 6) - 6e-7
    theta = F.when(F.col("n") < k, 0).otherwise(F.greatest(F.floor(low / (1 - low)) - 1, F.lit(0))).alias("theta")
    peak = postings.groupBy("term").agg(F.max("f").alias("peak"))
    known = asked.join(peak, "term").withColumn("peaks", F.sum("peak").over(Window.partitionBy("query_id"))).join(found.select("query_id", theta), "query_id")
    met = postings.join(known, (postings["term"] == known["term"]) & (F.col("f") * F.col("peaks") >= F.col("theta") * F.col("peak")))
    return met.select("query_id", "id").distinct()


def _counted(pairs: pa.Table, k: int, stems: bool):
    """query_id, id, f: of each batch of (id, words) the k first documents of each query, by pairs(query_id, term)."""
    query, term = (pairs.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
    names, number = query.dictionary, {t: i for i, t in enumerate(term.dictionary.to_pylist())}
    of_pair = term.indices.to_numpy()
    at_term = np.concatenate([[0], np.cumsum(np.bincount(of_pair, minlength=len(number)))])
    wanted = query.indices.to_numpy()[np.argsort(of_pair, kind="stable")]  # the queries of each term
    stop = set(T.ENGLISH_STOP_WORDS)

    def best(rank: np.ndarray, row: np.ndarray, term: np.ndarray, n: np.ndarray):
        """(query, row, f) of some rows' counts n of terms; rank is the rows' place by id."""
        low, high = int(row[0]), int(row[-1]) + 1
        each = at_term[term + 1] - at_term[term]
        link = np.repeat(at_term[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        f = np.bincount(np.repeat(row - low, each) * len(names) + wanted[link], np.repeat(n, each), (high - low) * len(names)).astype(np.int64).reshape(-1, len(names))
        # the score in whole millionths, rounded half up, above the place by id: no two are the same
        key = ((2_000_000 * f + f + 1) // (2 * (f + 1)) * len(rank) + len(rank) - 1 - rank[low:high, None]) * (f > 0) - (f == 0)
        first = np.argpartition(-key, k - 1, axis=0)[:k] if len(key) > k else np.broadcast_to(np.arange(len(key))[:, None], key.shape)
        q = np.broadcast_to(np.arange(len(names)), first.shape)
        found = key[first, q] >= 0
        return q[found], first[found] + low, f[first[found], q[found]]

    def run(batches):
        for b in batches:
            lists = b.column(1)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            of_word = np.array([-1 if w in stop else number.get(S.stem(w), -1) for w in words] if stems else [number.get(w, -1) for w in words], np.int64)
            size = lists.value_lengths().fill_null(0).to_numpy()
            found = of_word[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
            key = (np.repeat(np.arange(len(size)), size) * len(number) + found)[found >= 0]
            key, n = np.unique(key, return_counts=True)
            row, term = key // max(len(number), 1), key % max(len(number), 1)
            order = pc.rank(b.column(0), sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64) - 1
            links = np.cumsum(at_term[term + 1] - at_term[term])
            start = 0
            while start < len(row):
                # whole rows, one at least
                end = min(np.searchsorted(links, (links[start - 1] if start else 0) + SUMMED, "right"), np.searchsorted(row, row[start] + max(1, SUMMED // len(names))))
                end = np.searchsorted(row, row[end]) if end < len(row) else end
                end = end if end > start else np.searchsorted(row, row[start], "right")
                q, r, f = best(order, row[start:end], term[start:end], n[start:end])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), b.column(0).take(pa.array(r)), pa.array(f)], ["query_id", "id", "f"])
                start = end

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, stems: bool = True, counted: int = COUNTED) -> DataFrame:
    """query_id, id, score (f / (f + 1)), rank: the first k of index(id, text) for each of queries(query_id, query).

    Ties go to the smaller id. Null and empty texts hold no term; a query without a term has no row. Repeated ids add up.
    Queries of at most `counted` distinct terms, summed over queries, are known to every task.
    """
    asked = asked_terms(queries, stems)
    index = index.where("id is not null").select("id", "text")
    known = asked.where("query_id is not null").limit(counted + 1).toArrow()
    once, several = by_ids(index) if known.num_rows <= counted else (None, index)
    sums = []
    if once is not None:
        bounded_batches(index.sparkSession)
        out = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("id", index.schema["id"].dataType), StructField("f", LongType())])
        sums.append(once.select("id", _cut(F.col("text"), stems).alias("words")).mapInArrow(_counted(known, k, stems), out))
    if several is not None:
        postings = written((_stem_postings if stems else _plain_postings)(several, asked))
        sums.append(_sums(candidates(postings, asked, k), postings, asked))
    both = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    scored = both.select("query_id", "id", F.round(F.col("f") / (F.col("f") + 1), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
