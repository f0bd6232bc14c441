"""Incremental maintenance: micro-batches of events and products keep stored tables equal to a batch run.

A table is dealt into buckets of its key. A batch recomputes just the keys that it touches and
writes their buckets to a new folder; a small manifest, renamed into place, then says which folder holds each bucket.
So readers see all of a change or nothing of it, and a batch that fails on the way changes nothing; run again, it
does the same. Summaries merge with what is stored, since the latest of the latest is the latest; only impression
counts go back to the log of impressions, by the pairs touched. The result is that of a run from scratch, also for
events that come late or twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recoflux import schema
from recoflux.config import EngineConfig
from recoflux.operators import content, models, strengths, summaries, templates
from recoflux.sources import scans, sinks

BUCKETS = 16


class Tables:
    """Stored tables of a tenant below a root folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def _names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._files.listStatus(self._path(path))) if self._exists(path) else []

    def manifest(self, name: str) -> dict:
        """The newest: `parts` (by bucket, or `base` for a log) and what else its writer noted; {} where there is none."""
        folder = f"{self.path(name)}/manifest"
        found = [x for x in self._names(folder) if x.endswith(".json")]
        if not found:
            return {}
        stream = self._files.open(self._path(f"{folder}/{found[-1]}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) | {"number": int(found[-1].removesuffix(".json"))}

    def publish(self, name: str, last: dict, **new) -> None:
        """A manifest that follows `last`. Folders that it no longer names go with the manifest after it, so that running reads end."""
        number, folder = last.get("number", -1) + 1, f"{self.path(name)}/manifest"
        gone = sorted(set(last.get("parts", {}).values()) - set(new["parts"].values()))
        draft = self._path(f"{folder}/{uuid.uuid4().hex}.draft")
        stream = self._files.create(draft, True)
        stream.write(json.dumps(new | {"gone": gone}).encode())
        stream.close()
        if not self._files.rename(draft, self._path(f"{folder}/{number:012d}.json")):
            raise RuntimeError(f"table {name} was changed by another writer")
        for path in last.get("gone", []):
            self._files.delete(self._path(path), True)
        if number > 1:
            self._files.delete(self._path(f"{folder}/{number - 2:012d}.json"), False)

    def log(self, name: str, batch: DataFrame, batch_id: int) -> None:
        """Append a batch to a log; a batch that is there is written again, one that was merged into the base isn't."""
        if batch_id not in self.manifest(name).get("merged", []):
            batch.write.mode("overwrite").parquet(f"{self.path(name)}/batch={batch_id}")

    def log_parts(self, name: str) -> tuple[dict, list[int]]:
        """The log's manifest, and the batches that come on top of its base."""
        last = self.manifest(name)
        found = [int(x.removeprefix("batch=")) for x in self._names(self.path(name)) if x.startswith("batch=")]
        return last, [k for k in found if k not in last.get("merged", []) and self._exists(f"{self.path(name)}/batch={k}/_SUCCESS")]

    def read_log(self, name: str, columns) -> DataFrame:
        last, batches = self.log_parts(name)
        return self._parquet([*last.get("parts", {}).values(), *(f"{self.path(name)}/batch={k}" for k in batches)], columns)

    def rewrite_log(self, name: str, rows: DataFrame) -> None:
        """rows, made of the log, in place of all that is in it."""
        last, batches = self.log_parts(name)
        base = f"{self.path(name)}/base-{uuid.uuid4().hex}"
        rows.write.parquet(base)
        self.publish(name, last, parts={"base": base}, merged=sorted({*last.get("merged", []), *batches}))

    def _parquet(self, paths: list[str], columns) -> DataFrame:
        return self.spark.read.schema(columns).parquet(*paths) if paths else self.spark.createDataFrame([], columns)

    def exists(self, name: str) -> bool:
        return bool(self.manifest(name))

    def read(self, name: str, columns) -> DataFrame:
        return self._parquet(sorted(self.manifest(name).get("parts", {}).values()), columns)

    def bucket(self, keys: list[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def replace(self, name: str, columns, new: DataFrame, touched: DataFrame, keys: list[str]) -> None:
        """The rows of touched keys go and new ones come; other buckets stay as they are."""
        last = self.manifest(name)
        parts = last.get("parts", {})
        hit = [str(r.bucket) for r in touched.select(self.bucket(keys).alias("bucket")).distinct().collect()]  # no more than buckets
        old = self._parquet([parts[b] for b in hit if b in parts], columns).join(touched.select(*keys).distinct(), keys, "left_anti")
        version = f"{self.path(name)}/{uuid.uuid4().hex}"
        rows = old.unionByName(new.select(*columns.fieldNames())).withColumn("bucket", self.bucket(keys))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(version)
        written = set(self._names(version))
        parts = {b: p for b, p in parts.items() if b not in hit} | {b: f"{version}/bucket={b}" for b in hit if f"bucket={b}" in written}
        self.publish(name, last, parts=parts)


class Lanes:
    """Handlers of micro-batches. Each can be given to foreachBatch, or called with a DataFrame and a batch number."""

    def __init__(self, tables: Tables, config: EngineConfig):
        self.tables, self.config = tables, config

    # logs and summaries
    def activities(self) -> DataFrame:
        return self.tables.read_log("activities", schema.ACTIVITIES)

    def impressions(self) -> DataFrame:
        return self.tables.read_log("impressions", schema.IMPRESSIONS)

    def summary(self) -> DataFrame:
        return self.tables.read("activity_summary", schema.SUMMARY)

    def impression_summary(self) -> DataFrame:
        return self.tables.read("impression_summary", schema.IMPRESSION_SUMMARY)

    def popularity(self) -> DataFrame:
        return self.tables.read("popularity", schema.POPULARITY)

    def strengths(self, entity: str) -> DataFrame:
        return self.tables.read(f"{entity}_strengths", self._columns(entity))

    def templates(self, entity: str) -> DataFrame:
        return self.tables.read(f"{entity}_templates", schema.TEMPLATES)

    @staticmethod
    def _columns(entity: str):
        return schema.UU_STRENGTHS if entity == "user" else schema.PP_STRENGTHS

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.where(~scans.anonymous("user", self.config.anonymous_prefix))

    def fast(self, batch: DataFrame, batch_id: int) -> None:
        """Activities: their pairs' summaries, impression counts and their products' popularity. Types that aren't supported are left out."""
        batch = batch.where(F.col("activity").isin(list(self.config.activities)) & F.col("user").isNotNull() & F.col("product").isNotNull())
        self.tables.log("activities", batch, batch_id)
        columns = ["user", "product", "activity", "created_at"]
        pairs = batch.select("user", "product").distinct()
        known = self.summary().join(pairs, ["user", "product"], "left_semi").select(*columns)
        rows = summaries.activity_summary(known.unionByName(batch.select(*columns)).withColumn("anonymous", F.lit(False)), self.config)
        self.tables.replace("activity_summary", schema.SUMMARY, rows, pairs, ["user", "product"])
        self._impressions_of(pairs)
        self._popularity_of(batch.select("product").distinct())

    def _popularity_of(self, products: DataFrame) -> None:
        rows = summaries.popularity(self._named(self.summary()).join(products, "product", "left_semi"), self.config)
        self.tables.replace("popularity", schema.POPULARITY, rows, products.select(F.col("product").alias("p_id")), ["p_id"])

    def shown(self, batch: DataFrame, batch_id: int) -> None:
        """Impressions: their pairs' counts."""
        self.tables.log("impressions", batch.where(F.col("user").isNotNull() & F.col("product").isNotNull()), batch_id)
        self._impressions_of(batch.select("user", "product").distinct())

    def _impressions_of(self, pairs: DataFrame) -> None:
        """The pairs' impressions after their last activity, which their summary holds."""
        if not any(self.tables.log_parts("impressions")):
            return
        keys = ["user", "product"]
        rows = summaries.impression_summary(self.impressions().join(pairs, keys, "left_semi"), self.summary().join(pairs, keys, "left_semi"), self.config)
        touched = pairs.select(F.col("user").alias("u_id"), F.col("product").alias("p_id"))
        self.tables.replace("impression_summary", schema.IMPRESSION_SUMMARY, rows, touched, ["u_id", "p_id"])

    def slow(self, batch: DataFrame, batch_id: int, entities: tuple[str, ...] = ("user", "product")) -> None:
        """Activities, after the fast lane: strengths of every user and product they can change, and those templates.

        Anonymous users are left out. entities: whose strengths are kept, of users, of products or (as a rule) of both; neither needs the other's.
        """
        changed = self._named(batch).select("user", "product").distinct()
        for roles in (strengths.user_roles(self.config), strengths.product_roles(self.config)):
            if roles.entity in entities:
                targets = strengths.affected_targets(changed, self._named(self.summary()), roles)
                self._strengths_of(roles, sinks.materialized(targets))

    def _strengths_of(self, roles: strengths.Roles, targets: DataFrame) -> None:
        """The targets' strengths from the summaries; lists of templates only where they have changed.

        Both are written as they are made: pairs are neither written first nor met with those before.
        """
        entity, columns = roles.entity, self._columns(roles.entity)
        shown = self.impression_summary() if self.config.impressions else None
        of = lambda best=None: strengths.strengths(self._named(self.summary()), roles, self.config, shown, targets, best=best)
        self.tables.replace(f"{entity}_strengths", columns, of(), targets, [entity])
        if entity == "user":
            lists = templates.cached(templates.user_templates(of(self.config.user_templates), self.config), entity)
        else:
            lists = templates.cached(self._best(roles, targets), entity)
        ids = targets.select(F.col(entity).alias("id"))
        old = self.templates(entity).join(ids, "id", "left_semi").withColumnRenamed("templates", "_old")
        both = sinks.materialized(old.join(lists, "id", "full").where(~F.col("templates").eqNullSafe(F.col("_old"))).select("id", "templates"))
        self.tables.replace(f"{entity}_templates", schema.TEMPLATES, both.where(F.col("templates").isNotNull()), both.select("id"), ["id"])

    def _best(self, roles: strengths.Roles, targets: DataFrame) -> DataFrame:
        best = self.strengths(roles.entity).join(targets, roles.entity, "left_semi")
        return templates.user_templates(best, self.config) if roles.entity == "user" else templates.product_templates(best, self.config)

    def _consolidate(self, roles: strengths.Roles, targets: DataFrame) -> None:
        entity = roles.entity
        self.tables.replace(f"{entity}_templates", schema.TEMPLATES, templates.cached(self._best(roles, targets), entity), targets.select(F.col(entity).alias("id")), ["id"])

    def expire(self, now, days: int = 30) -> None:
        """Anonymous users' activities older than the time to live go, from the log and all that is made of it.

        The log is replaced last: after a crash on the way, expire() does the same again. Popularity, strengths and templates
        are made without anonymous users, so nothing there expires.
        """
        prefix, keys = self.config.anonymous_prefix, ["user", "product"]
        log = self.activities().withColumn("anonymous", scans.anonymous("user", prefix))
        kept = sinks.materialized(sinks.expire(log, now, days).select(*schema.ACTIVITIES.fieldNames()))
        pairs = sinks.materialized(log.where(F.col("anonymous") & (F.col("created_at") < F.lit(now) - F.make_interval(days=F.lit(days)))).select(*keys).distinct())
        rows = summaries.activity_summary(kept.join(pairs, keys, "left_semi"), self.config, named_only=False)
        self.tables.replace("activity_summary", schema.SUMMARY, rows, pairs, keys)
        self._impressions_of(pairs)
        self.tables.rewrite_log("activities", kept)

    # products
    def terms(self) -> DataFrame:
        return self.tables.read("terms", schema.TERMS)

    def products_of(self, batch: DataFrame, batch_id: int, stemmed: bool = True) -> None:
        """Products, new or changed: their terms replace what the products had before."""
        rows = models.term_frequencies(batch, self.config, stemmed).select(*schema.TERMS.fieldNames())
        self.tables.replace("terms", schema.TERMS, rows, batch.select(F.col("external_id").alias("product")), ["product"])

    def delete_products(self, ids: DataFrame) -> None:
        """The products (external_id) go from terms, popularity and strengths, and from the templates of all other products."""
        gone = sinks.materialized(ids.select(F.col("external_id").alias("product")).distinct())
        empty = lambda columns: self.tables.spark.createDataFrame([], columns)
        self.tables.replace("terms", schema.TERMS, empty(schema.TERMS), gone, ["product"])
        if self.tables.exists("popularity"):
            self.tables.replace("popularity", schema.POPULARITY, empty(schema.POPULARITY), gone.select(F.col("product").alias("p_id")), ["p_id"])
        if self.tables.exists("product_strengths"):
            templates_gone = gone.select(F.col("product").alias("template_product"))
            near = self.strengths("product").join(templates_gone, "template_product", "left_semi").select("product").unionByName(gone).distinct()
            near = sinks.materialized(near)
            left = self.strengths("product").join(near, "product", "left_semi").join(templates_gone, "template_product", "left_anti").join(gone, "product", "left_anti")
            self.tables.replace("product_strengths", schema.PP_STRENGTHS, left, near, ["product"])
            self._consolidate(strengths.product_roles(self.config), near)

    def weights(self, total: int) -> DataFrame:
        """tf-idf over all stored terms. Frequencies are recounted, so repeated products don't inflate them."""
        terms = self.terms()
        return models.tf_idf(terms, models.document_frequencies(terms), total, self.config.top_terms)

    def similarities(self, total: int, product_models: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        """Content strengths, of the target products (product) alone if given."""
        return content.content_strengths(self.weights(total), product_models, self.config, targets)


def start(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run a handler on a stream's micro-batches; with once, on what is there and no longer. stop() ends it after the current batch."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def since_last_run(products: DataFrame, log: DataFrame, kind: str, column: str = "updated_at") -> DataFrame:
    """Products updated at or after the last successful run of a kind; all of them if there was none."""
    last = log.where((F.col("type") == kind) & (F.col("status") == "success")).agg(F.max("timestamp").alias("_last"))
    rows = products.withColumn("_one", F.lit(1)).join(F.broadcast(last.withColumn("_one", F.lit(1))), "_one")
    return rows.where(F.col("_last").isNull() | (F.col(column) >= F.col("_last"))).drop("_one", "_last")


def hourly_activity(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Activities per hour and type, closed once the watermark has passed; later events are left out."""
    return stream.withWatermark("created_at", lateness).groupBy(F.window("created_at", "1 hour").alias("hour"), "activity").agg(F.count(F.lit(1)).alias("n"))
