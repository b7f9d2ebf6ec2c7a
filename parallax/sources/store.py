"""Stores on parquet: upserts, append-only logs, a content-addressed cache, exports.

A write makes a new version of a table in a folder beside the old ones; readers take the newest that is complete (marked
_SUCCESS), so they see whole versions and a job that dies leaves the old one. A writer claims its number by creating a file that must not
exist yet, so two writers never share a version; the greater number is what readers see. Appends add files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parallax.session import checkpoint


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None, order: Column | None = None) -> DataFrame:
    """``old`` with ``new`` merged in by key: new rows are added, of known ones the columns ``update`` (all, if None) are replaced.

    Of several new rows of one key the last in ``order`` counts.
    """
    if order is not None:
        new = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("__n = 1").drop("__n")
    else:
        new = new.dropDuplicates(list(keys))
    update = [c for c in old.columns if c not in keys] if update is None else list(update)
    fresh = new.select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in old.columns if c not in keys])
    both = old.withColumn("__old", F.lit(True)).join(fresh, list(keys), "full_outer")
    value = lambda c: F.when(F.col("__old").isNull() | (F.col("__new").isNotNull() & F.lit(c in update)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[F.col(c) if c in keys else value(c) for c in old.columns])


class Table:
    """A versioned parquet table in a folder; ``schema`` is its DDL, and columns it gained later read as null."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)

    def _version(self) -> int:
        if not self._hadoop.exists(self._at(self.path)):
            return -1
        names = [s.getPath().getName() for s in self._hadoop.listStatus(self._at(self.path))]
        done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._hadoop.exists(self._at(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=-1)

    def read(self) -> DataFrame:
        v = self._version()
        if v < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}")

    def overwrite(self, df: DataFrame) -> None:
        """A new version; the versions before it stay until ``vacuum``."""
        df.select(*[c.strip().split(" ")[0] for c in self.spark.createDataFrame([], self.schema).columns]).write.mode("overwrite").parquet(f"{self.path}/v{self._claim()}")

    def _claim(self) -> int:
        """A version number that no other writer has."""
        self._hadoop.mkdirs(self._at(self.path))
        v = self._version() + 1
        while not self._hadoop.createNewFile(self._at(f"{self.path}/_claim_{v}")):
            v += 1
        return v

    def merge(self, new: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None, order: Column | None = None) -> None:
        self.overwrite(upsert(self.read(), new, keys, update, order))

    def append(self, df: DataFrame, id: str | None = None) -> None:
        """Rows added to the current version; ``id`` is numbered on from its maximum, by partitions, without a global sort."""
        if id is not None:
            base = self.read().agg(F.coalesce(F.max(id), F.lit(0)).alias("m")).first()["m"]
            df = number_rows(df, id, base)
        df.write.mode("append").parquet(f"{self.path}/v{max(self._version(), 0)}")

    def vacuum(self) -> int:
        """Older versions removed; how many."""
        last, gone = self._version(), 0
        for v in range(last):
            if self._hadoop.exists(self._at(f"{self.path}/v{v}")):
                gone += bool(self._hadoop.delete(self._at(f"{self.path}/v{v}"), True))
        return gone


def number_rows(df: DataFrame, name: str, base: int) -> DataFrame:
    """Consecutive numbers after ``base``: counts of partitions are added up, and rows numbered inside them.

    The marks are checkpointed, as both uses must see the same partitions whatever is coalesced or run again.
    """
    marked = checkpoint(df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    before = marked.groupBy("__p").agg(F.count(F.lit(1)).alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__m"))
    numbered = marked.withColumn("__i", inside).join(F.broadcast(before), "__p")
    return numbered.withColumn(name, (F.lit(base) + F.col("__before") + F.col("__i")).cast("bigint")).drop("__p", "__m", "__i", "__before")


class Cache:
    """Answers by (namespace, key) in parquet partitioned by namespace; a key is a hash of its payload.

    Failures (null answers) are not stored, unless ``failed`` says as what: then they are not asked again. Only a
    folder that does not exist is an empty cache; any other trouble is an error, not a reason to compute everything again.
    """

    def __init__(self, spark: SparkSession, path: str, failed: str | None = None):
        self.spark, self.path, self.failed, self.hits, self.misses = spark, path, failed, 0, 0

    def _folder(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path + name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _stored(self, namespace: str) -> DataFrame:
        system, path = self._folder(f"/namespace={namespace}")
        if not system.exists(path):
            return self.spark.createDataFrame([], "key string, value string, stored_at timestamp")
        return self.spark.read.schema("key string, value string, stored_at timestamp, namespace string").parquet(self.path).where(F.col("namespace") == namespace).drop("namespace")

    def _all(self, namespace: str) -> DataFrame:
        """(key, value), of several answers to a key the first."""
        return self._stored(namespace).groupBy("key").agg(F.min_by("value", F.struct("stored_at", "value")).alias("value"))

    def get_or_compute(self, namespace: str, payload: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(key, value): ``compute`` gets the rows of ``payload`` (key, ...) without an answer and gives (key, value)."""
        known = self._all(namespace)
        wanted = payload.dropDuplicates(["key"])
        marked = checkpoint(wanted.join(known.select("key", F.lit(True).alias("__known")), "key", "left"))  # counted, computed and answered from one reading
        counts = marked.agg(F.count("__known").alias("hits"), F.count_if(F.col("__known").isNull()).alias("misses")).first()
        self.hits, self.misses = self.hits + counts["hits"], self.misses + counts["misses"]
        wanted = marked.drop("__known")
        if counts["misses"]:
            value = F.col("value") if self.failed is None else F.coalesce("value", F.lit(self.failed))
            fresh = compute(marked.where("__known is null").drop("__known")).select("key", value.alias("value"), F.current_timestamp().alias("stored_at"), F.lit(namespace).alias("namespace"))
            fresh.where("value is not null").write.mode("append").partitionBy("namespace").parquet(self.path)
        return self._all(namespace).join(wanted.select("key"), "key", "left_semi")

    def clear(self, namespace: str) -> int:
        """The entries of a namespace removed; how many."""
        n = self._all(namespace).count()
        system, target = self._folder(f"/namespace={namespace}")
        system.delete(target, True)
        return n

    def trim(self, namespace: str, most: int) -> int:
        """The oldest entries of a namespace removed until about ``most`` are left, those of one moment together; how many."""
        rows = checkpoint(self._stored(namespace))
        n = rows.count()
        if n <= most:
            return 0
        # The moment that bounds the newest ``most`` entries, by counts of moments, of which a run has one.
        moments = rows.groupBy("stored_at").agg(F.count(F.lit(1)).alias("n")).withColumn("newer", F.sum("n").over(Window.orderBy(F.desc("stored_at"))))
        kept = checkpoint(rows.join(moments.where(F.col("newer") <= most).select("stored_at"), "stored_at", "left_semi"))
        left = kept.count()
        system, target = self._folder(f"/namespace={namespace}")
        system.delete(target, True)
        kept.withColumn("namespace", F.lit(namespace)).write.mode("append").partitionBy("namespace").parquet(self.path)
        return n - left

    def stats(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses}


def history(rows: DataFrame, time: str = "created_at", **equal: str) -> DataFrame:
    """Rows that equal the given columns (the decisions of a pair, the claims of an entity), oldest first."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(time, *[c for c in ("id",) if c in rows.columns])


def cost_summary(events: DataFrame, *, amount: str = "est_cost_usd", groups: Sequence[str] = ("provider", "namespace"), where: Column | None = None) -> DataFrame:
    """(groups, events, total): all, and by each of ``groups``, in one pass; null marks all. Null amounts count as zero."""
    rows = events if where is None else events.where(where)
    cols = [F.col(g) for g in groups]
    return rows.groupingSets([[], *[[c] for c in cols]], *cols).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"), F.grouping_id(*cols).alias("level"))


def total_cost(events: DataFrame, amount: str = "est_cost_usd", **equal: str | None) -> DataFrame:
    """(total): the sum over rows that equal the given columns; zero for none."""
    for name, value in equal.items():
        if value is not None:
            events = events.where(F.col(name) == value)
    return events.agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"))


def price_events(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Events with est_cost_usd by a price table (model, in_rate, out_rate), which is a parameter; an unknown model costs zero."""
    from parallax.functions.scalars import model_cost

    joined = events.join(prices.select("model", "in_rate", "out_rate").dropDuplicates(["model"]), "model", "left")
    hour = F.coalesce(F.col("cache_ttl") == "1h", F.lit(False)) if "cache_ttl" in events.columns else F.lit(False)
    cost = model_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("in_rate"), F.col("out_rate"), hour)
    return joined.withColumn("est_cost_usd", cost).drop("in_rate", "out_rate")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, rows: int = 100) -> str:
    """A small summary as Markdown: a report of at most ``rows`` rows."""
    got = df.limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else json.dumps(v) if isinstance(v, list) else str(v) for v in r) + " |" for r in got)])
