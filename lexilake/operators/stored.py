"""Tables in folders that take upserts, additions, removals and promotions; every change is whole or absent.

A table is Parquet files in buckets of its key, and numbered manifests that name each bucket's folders. A change writes
new folders first and its manifest last, under the next number, which only one writer can take. A run that is lost
before that leaves files that no manifest names, and the table as it was; a rerun does the change anew. Files are never
changed, so a reader keeps what it began to read. Folders of older manifests stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexilake.operators import upkeep as U

_BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer changed the table since this change began; nothing was done."""


class Stored:
    """The table in the folder `path`, any file system of Hadoop's. buckets holds for a new table: some GB of data each."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # -- files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of the table's manifests, ascending; none for a table that nothing was written to."""
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "key": self.key, "buckets": self.buckets, "schema": None, "parts": {}, "done": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{found[-1] if version is None else version:012d}.json", wholetext=True).first()[0])

    def _commit(self, now: dict) -> None:
        """The manifest under its number, by a rename that fails where another has taken the number."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        made, final = self._path(f"manifests/{uuid.uuid4().hex}.new"), self._path(f"manifests/{now['version']:012d}.json")
        out = made.getFileSystem(conf).create(made, False)
        try:
            out.write(json.dumps(now).encode())
        finally:
            out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), conf).rename(made, final, plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self.path} has a version {now['version']}") from e
            raise

    def _write(self, rows: DataFrame, old: dict) -> dict[str, list[str]]:
        """The rows in a new folder, dealt by bucket (a large bucket over several tasks); the parts that it has."""
        folder = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(old["key"]), F.lit(old["buckets"])).cast("int")
        rows.withColumn(_BUCKET, bucket).hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in self._names(folder) if n.startswith(f"{_BUCKET}=")}

    def _rows(self, state: dict, parts: dict[str, list[str]]) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = sorted(f"{self.path}/{f}" for folders in parts.values() for f in folders)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # -- what it offers

    def read(self, version: int | None = None) -> DataFrame:
        state = self._manifest(version)
        if state["schema"] is None:
            raise ValueError(f"nothing is stored in {self.path}")
        return self._rows(state, state["parts"])

    def _fitted(self, rows: DataFrame, state: dict, order: str | None = None) -> DataFrame:
        """The rows with the table's columns, cast to its types, and _order; the first rows give the table its columns."""
        if _BUCKET in rows.columns:
            raise ValueError(f"{_BUCKET} is no column's name here")
        if state["schema"] is None:
            state["schema"] = json.loads((rows.drop(order) if order else rows).schema.json())
        own = (F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromJson(state["schema"]))
        return rows.select(*own, *([F.col(f"`{order}`").alias("_order")] if order else []))

    def _change(self, batch_id: str | None, change: Callable[[dict], dict[str, list[str]]]) -> bool:
        state = self._manifest()
        if batch_id is not None and batch_id in state["done"]:
            return False
        state["parts"] = change(state)
        self._commit(state | {"version": state["version"] + 1, "done": state["done"] + [batch_id] * (batch_id is not None)})
        return True

    def append(self, batch: DataFrame, batch_id: str | None = None) -> bool:
        """Adds rows, keys unread. False, and nothing done, where a batch of this batch_id was added before.

        Batch ids stay in the manifest for good, one each.
        """

        def change(state: dict) -> dict[str, list[str]]:
            fresh = self._write(self._fitted(batch, state), state)
            return {b: state["parts"].get(b, []) + fresh.get(b, []) for b in state["parts"] | fresh}

        return self._change(batch_id, change)

    def upsert(self, batch: DataFrame, order: str | None = None, batch_id: str | None = None) -> bool:
        """The batch's rows in place of those of the same key, as upkeep.upsert; only buckets that it touches are rewritten.

        Of rows of one key in the batch the last by `order` stays, nulls first, rows of one order by a hash. Rows without
        a key are added; give a batch_id where a rerun must not add them twice.
        """

        def change(state: dict) -> dict[str, list[str]]:
            key, rows = state["key"], self._fitted(batch, state)
            placed = self._fitted(batch, state, order)
            own = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
            last = F.struct(F.lit(0) if order is None else F.col("_order"), F.xxhash64(*rows.columns))
            once = placed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(own, last).alias("_row"))
            fresh = self._write(once.select("_row.*").unionByName(rows.where(F.col(key).isNull())), state)
            return self._without(state, self._rows(state, fresh).select(key), fresh)

        return self._change(batch_id, change)

    def remove(self, keys: DataFrame, batch_id: str | None = None) -> bool:
        """Drops rows whose key is among keys, a table with that column; only buckets that hold such keys are rewritten."""

        def change(state: dict) -> dict[str, list[str]]:
            if state["schema"] is None:
                return {}
            key = state["key"]
            kind = StructType.fromJson(state["schema"])[key].dataType
            named = self._write(keys.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias(key)).distinct(), state)
            paths = [f"{self.path}/{f}" for folders in named.values() for f in folders]
            if not paths:
                return state["parts"]
            return self._without(state, self.spark.read.schema(StructType([StructType.fromJson(state["schema"])[key]])).parquet(*paths), dict.fromkeys(named, []))

        return self._change(batch_id, change)

    def _without(self, state: dict, keys: DataFrame, fresh: dict[str, list[str]]) -> dict[str, list[str]]:
        """The parts with fresh's buckets rewritten without the keys, and fresh's own folders added."""
        touched = {b: state["parts"][b] for b in fresh if b in state["parts"]}
        kept = self._write(self._rows(state, touched).join(keys, state["key"], "left_anti").select(*StructType.fromJson(state["schema"]).names), state) if touched else {}
        parts = {b: kept.get(b, []) + fresh[b] if b in fresh else folders for b, folders in (state["parts"] | fresh).items()}
        return {b: folders for b, folders in parts.items() if folders}

    def rewrite(self, change: Callable[[DataFrame], DataFrame], batch_id: str | None = None) -> bool:
        """The whole table as change makes it of its rows."""
        return self._change(batch_id, lambda state: self._write(self._fitted(change(self._rows(state, state["parts"])), state), state))

    def promote(self, source: str, target: str, archive: str | None = None, batch_id: str | None = None) -> bool:
        """upkeep.promote on the stored rows: target's old rows go, or stay in the archive of that name."""
        return self.rewrite(lambda rows: U.promote(rows, source, target, archive), batch_id)


def new_files(files: DataFrame, loaded: DataFrame, namespace: str) -> DataFrame:
    """The files(file_hash, ...) that the namespace, or one below it, of loaded(file_hash, namespace) does not hold yet.

    Files without a hash are always new.
    """
    known = loaded.where(U.in_namespace(F.col("namespace"), namespace)).select("file_hash").distinct()
    return files.join(known, "file_hash", "left_anti").select(*files.columns)


def cacheable(answers: DataFrame, now, hours: int = 4) -> DataFrame:
    """Rows to store of answers(cache_key, documents, ...): those with documents, and the time until which they hold."""
    return answers.where(F.size("documents") > 0).withColumn("expires_at", now + F.make_interval(hours=F.lit(hours)))
