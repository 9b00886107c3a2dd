"""Files as tables: documents to ingest, query lists and cases, CSV results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def discover(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """path, filename, length, file_hash of the files below root that fit the pattern, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "length", F.sha2("content", 256).alias("file_hash"))


def file_metadata(filename: Column) -> Column:
    """struct<source, part, classification> by a file's name; source and part are null where it says nothing."""
    none = F.lit(None).cast("string")
    far, manual = filename.startswith("FAR_"), filename.contains("EM 385") | filename.contains("EM_385")
    source = F.when(far, "FAR").when(filename.startswith("DFARS_"), "DFARS").when(manual, "EM385").otherwise(none)
    part = F.when(far, F.nullif(F.regexp_extract(filename, r"FAR_(\d+)", 1), F.lit(""))).when(filename.startswith("DFARS_"), "201-253").when(manual, "1-1")
    return F.struct(source.alias("source"), part.alias("part"), F.lit("regulation").alias("classification"))


def table_text(headers: Column, rows: Column, most: int = 30) -> Column:
    """A table's headers and first rows, a line each, cells parted by a bar."""
    line = lambda cells: F.array_join(F.transform(cells, lambda c: F.coalesce(c.cast("string"), F.lit(""))), " | ")
    head = F.when(F.size(headers) > 0, F.array(line(headers))).otherwise(F.array().cast("array<string>"))
    return F.trim(F.array_join(F.concat(head, F.transform(F.slice(F.coalesce(rows, F.array().cast("array<array<string>>")), 1, most), line)), "\n"))


def table_grid(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, headers, rows of each of tables(table_id, num_rows, num_cols), from the spans of its cells
    (table_id, cell, row_from, row_to, col_from, col_to, text, header); both ends of a span are inside it.

    Where spans meet, the first text that isn't blank stays. The headers are the first row with a header cell, else the
    first row; blank ones are named col_1, col_2 and so on. Blank rows are left out, as are parts of spans outside the
    table. A table without cells, rows or columns has no headers and no rows.
    """
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r\f\x0B"))
    least, most = (lambda c: F.greatest(F.col(c), F.lit(0))), (lambda c, n: F.least(F.col(c), F.col(n) - 1))
    spans = cells.join(tables, "table_id").withColumns({"_a": least("row_from"), "_z": most("row_to", "num_rows"), "_l": least("col_from"), "_r": most("col_to", "num_cols")})
    spans = spans.where("_a <= _z and _l <= _r").select("table_id", "num_cols", "cell", F.nullif(text, F.lit("")).alias("t"), F.coalesce("header", F.lit(False)).alias("h"), F.explode(F.sequence("_a", "_z")).alias("r"), "_l", "_r")
    placed = spans.withColumn("c", F.explode(F.sequence("_l", "_r")))
    grid = placed.groupBy("table_id", "num_cols", "r", "c").agg(F.min_by("t", F.when(F.col("t").isNotNull(), F.col("cell"))).alias("t"), F.max("h").alias("h"))
    lines = grid.groupBy("table_id", "num_cols", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", F.coalesce("t", F.lit("")).alias("t")))).alias("m"), F.max("h").alias("h"))
    line = F.transform(F.sequence(F.lit(0), F.col("num_cols") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    each = lines.select("table_id", "num_cols", F.struct("r", line.alias("t")).alias("x"), "h")
    found = each.groupBy("table_id", "num_cols").agg(F.array_sort(F.collect_list("x")).alias("all"), F.coalesce(F.min(F.when(F.col("h"), F.col("x.r"))), F.lit(0)).alias("at"))
    at = F.col("at")
    head = F.element_at(F.concat(F.filter("all", lambda x: x["r"] == at), F.array(F.struct(at.alias("r"), F.transform(F.sequence(F.lit(1), "num_cols"), lambda c: F.lit("")).alias("t")))), 1)["t"]
    named = F.transform(head, lambda t, i: F.when(t != "", t).otherwise(F.concat(F.lit("col_"), (i + 1).cast("string"))))
    body = F.transform(F.filter("all", lambda x: (x["r"] > at) & F.exists(x["t"], lambda t: t != "")), lambda x: x["t"])
    built = found.select("table_id", named.alias("headers"), body.alias("rows"))
    none = F.array().cast("array<string>")
    return tables.select("table_id").join(built, "table_id", "left").select("table_id", F.coalesce("headers", none).alias("headers"), F.coalesce("rows", F.array().cast("array<array<string>>")).alias("rows"))


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """query: the lines of a text file, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")


CASE = "id string, query string, expected_regulation string, must_contain_any array<string>, require_citation boolean, max_seconds double"


def query_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a JSON array; a citation is required where a case doesn't say."""
    cases = spark.read.schema(CASE).option("multiLine", "true").json(path)
    return cases.withColumn("require_citation", F.coalesce("require_citation", F.lit(True)))


def write_csv(rows: DataFrame, path: str) -> None:
    """The rows as CSV files with a header, one a partition."""
    rows.write.option("header", "true").mode("overwrite").csv(path)
