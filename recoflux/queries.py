"""The engine's queries over the bundled tables, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recoflux.config import Decay, EngineConfig
from recoflux.functions import bloom, scalars, text
from recoflux.operators import abtest, content, filters, merging, models, ranking, strengths, summaries, templates
from recoflux.plans import merges
from recoflux.plans import recommend as plans
from recoflux.sources import scans, sinks, testdata
from recoflux.streaming import lanes

Query = Callable[[SparkSession, str], DataFrame]
#: No near-identical filter, so that ranks alone are compared.
CONFIG = EngineConfig(near_identical_field=None)
UTC = timezone.utc


def at(*date: int) -> datetime:
    return datetime(*date, tzinfo=UTC)


def tables(spark: SparkSession, sf_dir: str, config: EngineConfig = CONFIG, keep: bool = False) -> plans.Tables:
    """The engine's tables; texts count as of languages without stems or stop words."""
    products = testdata.products(spark, sf_dir).withColumn("language", F.concat(F.lit("x-"), "language"))
    return plans.Tables(config, testdata.activities(spark, sf_dir), testdata.impressions(spark, sf_dir), products, stemmed=False, keep=keep)


def all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.users(spark, sf_dir).select(F.col("external_id").alias("user"))


def text_day(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd")


def flat(column: str) -> F.Column:
    return F.round(column, 9)


def summary_rows(df: DataFrame) -> DataFrame:
    return df.select("user", "product", "activity", text_day("day").alias("day"), F.unix_micros("created_at").alias("created_at"))


def impression_rows(df: DataFrame) -> DataFrame:
    return df.select("u_id", "p_id", "count", F.unix_micros("first").alias("first"))


def popularity_rows(df: DataFrame) -> DataFrame:
    return df.select("p_id", text_day("first").alias("first"), text_day("latest").alias("latest"), "count", flat("popularity").alias("popularity"))


def strength_rows(df: DataFrame, entity: str) -> DataFrame:
    return df.select(entity, f"template_{entity}", "nc", "na", "denominator", flat("strength").alias("strength"))


def template_rows(df: DataFrame, entity: str) -> DataFrame:
    return df.select(entity, F.col("place").cast("int").alias("place"), f"template_{entity}", flat("strength").alias("strength"))


def recommended(algorithm: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = plans.recommend(tables(spark, sf_dir, keep=True), sinks.materialized(all_users(spark, sf_dir)), 10, algorithm)
        score = lambda k: F.round(F.coalesce(F.get("score", k - 1), F.lit(0.0)), 6).alias(f"score_{k}")
        return rows.select("user", "rank", "product", score(1), score(2), score(3))

    return query


def merged(spark: SparkSession, sf_dir: str, algorithm: str, **settings) -> DataFrame:
    """Ten recommendations of a hybrid for every user, with near-identical titles put last."""
    config = CONFIG.with_(near_identical_field="title", **settings)
    return plans.recommend(tables(spark, sf_dir, config, keep=True), sinks.materialized(all_users(spark, sf_dir)), 10, algorithm)


def hybrid(algorithm: str, **settings) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        score = lambda k: F.round(F.coalesce(F.get("score", k - 1), F.lit(0.0)), 6).alias(f"score_{k}")
        return merged(spark, sf_dir, algorithm, **settings).select("user", "rank", "product", score(1), score(2), score(3), F.array_join("tags", ",").alias("tags"))

    return query


def popular_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.popular(tables(spark, sf_dir).popularity, 10)
    place = F.row_number().over(Window.orderBy(F.desc("popularity"), F.desc("p_id")))  # ten rows
    return rows.select("p_id", place.alias("rank"), "count", flat("popularity").alias("popularity"))


def voting_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, keep=True)
    ask = plans.Ask(all_users(spark, sf_dir), filters.filtered(t.models, None, CONFIG), 500, 30)
    rows = merges.votes(plans.all_lists(t, ask, ["UBCF", "PBCF", "CB"], 60), CONFIG.weights["HRVoting"], 30)
    return rows.select("user", "product", F.round("votes", 6).alias("votes"))


def with_impressions(entity: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir, CONFIG.with_(impressions=True), keep=True)
        return strength_rows(t.uu if entity == "user" else t.pp, entity)

    return query


def content_of(spark: SparkSession, sf_dir: str, ids: list[str]) -> DataFrame:
    """Content strengths of a few products with all others."""
    t = tables(spark, sf_dir, keep=True)
    return content.content_strengths(t.tfidf, t.models, CONFIG, named(spark, "product", *ids))


def decay_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x").cast("double")
    rows = testdata.read(spark, sf_dir, "events").select((F.col("event_id") % 30).alias("x")).distinct()
    of = lambda kind, p, low=0.0: scalars.decayed(x, Decay(kind, p), low)
    return rows.select("x", flat(of("linear", 7)).alias("linear"), flat(of("rational", 0)).alias("rational"), flat(of("exponential", 3)).alias("exponential"), of("step", 3, -1.0).alias("step"))


def similarity_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = testdata.read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_brand", "p_size")
    a, b = part.select(*[F.col(c).alias(f"a_{c}") for c in part.columns]), part.select(*[F.col(c).alias(f"b_{c}") for c in part.columns])
    rows = a.join(b, F.col("b_p_partkey") == F.col("a_p_partkey") + 1)
    day = lambda c: F.timestamp_seconds(F.col(c).cast("long") * 86400)
    return rows.select(
        F.col("a_p_partkey").alias("a"), F.col("b_p_partkey").alias("b"), flat(scalars.similar_numeric(F.col("a_p_retailprice"), F.col("b_p_retailprice"))).alias("numeric"),
        scalars.similar_fixed(F.col("a_p_brand"), F.col("b_p_brand")).alias("fixed"), flat(scalars.similar_date(day("a_p_size"), day("b_p_size"), 2.0)).alias("date"),
    )


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir).live_products.where(F.col("full_content").isNotNull()).select("external_id", text.tokenize(text.squeezed(F.col("full_content"))).alias("w"))
    return rows.select("external_id", F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("first"), F.element_at("w", F.when(F.size("w") > 0, -1)).alias("last"))


def context(condition: str, **more) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.filtered(tables(spark, sf_dir).models, condition, CONFIG)

    return query


def operands_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.materialized(tables(spark, sf_dir, keep=True).pp.withColumnsRenamed({"product": "entity", "template_product": "template"}))
    part = lambda k: rows.where(F.col("nc") % 3 != k)
    out = merging.merge_operands(part(0), part(1), part(2))
    return out.select("entity", "template", *[F.col(c).cast("double").alias(c) for c in ("nc", "na", "denominator")], flat("strength").alias("strength"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, keep=True).pp.select("product", "template_product", "nc", flat("strength").alias("strength"))
    new = rows.where(F.col("nc") % 2 == 0).withColumn("strength", F.lit(1.0))
    return sinks.upsert(rows, new, ["product", "template_product"]).drop("nc")


def incremented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.materialized(tables(spark, sf_dir, keep=True).pp)
    new = rows.where(F.col("nc") % 2 == 0).withColumns({"nc": F.lit(1).cast("long"), "na": F.lit(2).cast("long")})
    return sinks.increment(rows, new, ["product", "template_product"], ["nc", "na"])


def named(spark: SparkSession, column: str, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], f"{column} string")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = lambda kind: F.lit(None).cast(kind)
    rows = tables(spark, sf_dir).summary.withColumns({"uu_latest_type": blank("string"), "uu_latest_date": blank("timestamp")})
    return sinks.copy_marks(rows, "uu", at(2024, 1, 15)).select("user", "product", "uu_latest_type", F.unix_micros("uu_latest_date").cast("string").alias("uu_latest_date"))


def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = testdata.read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    a, b = docs.select(F.col("doc_id").alias("a"), F.col("w").alias("x")), docs.select(F.col("doc_id").alias("b"), F.col("w").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", text.common_terms(F.col("x"), F.col("y")).cast("long").alias("n"))


def bloom_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = testdata.read(spark, sf_dir, "events").select("user_id").distinct()
    rows = bloom.BloomFilter(users, "user_id", 1 << 16).accepts(users, "user_id")
    return rows.agg(F.count(F.lit(1)).alias("members"), F.sum(F.when(F.col("accepted"), 0).otherwise(1)).cast("long").alias("missed"))


def near_identical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language in order of their number as one ranked list; the words of the whole texts stand for stems."""
    docs = testdata.read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    words = F.split("text", " ")
    ids = F.concat(F.lit("p"), "doc_id")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    ranked = docs.select(F.col("lang").alias("user"), place.alias("rank"), ids.alias("product"))
    return content.near_identical(ranked, docs.select(ids.alias("external_id"), words.alias("title")), CONFIG.with_(near_identical_field="title", near_identical_threshold=40))


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{sinks.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def streamed(what: str) -> Query:
    """Three micro-batches of all events, dealt by number and so out of order, through the lanes."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lane = lanes.Lanes(lanes.Tables(spark, fresh_folder(spark, "lanes")), CONFIG)
        events = testdata._events(spark, sf_dir)
        for k in range(3):
            batch = events.where(F.col("event_id") % 3 == k)
            done = batch.where(F.col("activity") != "view").select("user", "product", "activity", "created_at", "anonymous")
            if what in ("impressions", "all"):
                lane.shown(batch.where(F.col("activity") == "view").select("user", "product", "created_at", "anonymous"), k)
            lane.fast(done, k)
            if what in ("user", "product"):
                lane.slow(done, k, (what,))
        return {"summary": lane.summary, "impressions": lane.impression_summary, "popularity": lane.popularity, "user": lambda: lane.strengths("user"), "product": lambda: lane.strengths("product")}[what]()

    return query


def streamed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in three batches, each again with the next, and some deleted ones on the way."""
    t = tables(spark, sf_dir)
    lane = lanes.Lanes(lanes.Tables(spark, fresh_folder(spark, "lanes")), CONFIG)
    number = F.crc32(F.encode("external_id", "UTF-8")) % 3
    gone = t.products.where(F.col("deleted_on").isNotNull())
    lane.products_of(gone, 0, stemmed=False)
    for k in range(3):
        lane.products_of(t.live_products.where(number.isin(k, (k + 1) % 3)), k + 1, stemmed=False)
    lane.delete_products(gone)
    return lane.terms().select("product", "attribute", "term", "count")


def streamed_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of products after one batch of all events and the deletion of three products."""
    lane = lanes.Lanes(lanes.Tables(spark, fresh_folder(spark, "lanes")), CONFIG)
    acts = testdata.activities(spark, sf_dir)
    lane.fast(acts, 0)
    lane.slow(acts, 0, ("product",))  # strengths of users have no part in what is asked
    lane.delete_products(named(spark, "external_id", "p3", "p4", "p50"))
    rows = lane.templates("product").select("id", F.posexplode("templates").alias("place", "t"))
    return rows.select(F.col("id").alias("product"), (F.col("place") + 1).cast("int").alias("place"), F.col("t.id").alias("template_product"), flat("t.strength").alias("strength"))


def streamed_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of users after two batches, of which the second rebuilds just the lists that it can change."""
    lane = lanes.Lanes(lanes.Tables(spark, fresh_folder(spark, "lanes")), CONFIG)
    acts = testdata._events(spark, sf_dir).where(F.col("activity") != "view")
    for k in range(2):
        batch = acts.where((F.col("event_id") % 50 == 0) == (k == 1)).drop("event_id")
        lane.fast(batch, k)
        lane.slow(batch, k, ("user",))
    rows = lane.templates("user").select("id", F.posexplode("templates").alias("place", "t"))
    return rows.select(F.col("id").alias("user"), (F.col("place") + 1).cast("int").alias("place"), F.col("t.id").alias("template_user"), flat("t.strength").alias("strength"))


def streamed_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries after anonymous users' activities have expired in the lanes."""
    lane = lanes.Lanes(lanes.Tables(spark, fresh_folder(spark, "lanes")), CONFIG)
    lane.fast(testdata.activities(spark, sf_dir), 0)
    lane.expire(at(2024, 1, 25), 10)
    return summary_rows(lane.summary())


def template_cache(t: plans.Tables) -> DataFrame:
    return sinks.materialized(templates.cached(t.user_templates, "user"))


def cached_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.templates_of(template_cache(tables(spark, sf_dir, keep=True)), ["u1", "u2", "u10"])
    return rows.select("id", F.col("place").cast("int").alias("place"), "template", flat("strength").alias("strength"))


def upserted_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of three users replaced, of one by nothing (which leaves the old one), and one new user's."""
    old = template_cache(tables(spark, sf_dir, keep=True))
    made = [("u1", [(0.5, "u2")]), ("u2", []), ("new", [(0.25, "u1"), (0.125, "u2")])]
    new = spark.createDataFrame(made, "id string, templates array<struct<strength:double,id:string>>")
    return sinks.upsert_templates(old, new, True).select("id", F.size("templates").cast("long").alias("n"), flat(F.get("templates", F.lit(0))["strength"]).alias("first"))


def swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is staged, one that is staged and published, one with rows on top, and one that rows were merged into."""
    store = sinks.Store(spark, fresh_folder(spark, "store"))
    counts = tables(spark, sf_dir).popularity.select("p_id", "count")
    for name in ("staged", "published", "appended", "merged"):
        store.write(name, counts)
    more = counts.where(F.col("count") % 2 == 0)
    store.stage("staged", more)
    store.publish(published=store.stage("published", more))
    store.append("appended", more)
    store.merge("merged", more.withColumn("count", F.lit(0).cast("long")).unionByName(spark.createDataFrame([("new", 7)], "p_id string, count long")), ["p_id"])
    one = lambda name: store.read(name).agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total")).select(F.lit(name).alias("name"), "n", "total")
    return one("staged").unionAll(one("published")).unionAll(one("appended")).unionAll(one("merged"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sinks.Store(spark, fresh_folder(spark, "store"))
    began = datetime.now(UTC)
    for kind, status in (("a", "running"), ("b", "running"), ("a", "success"), ("b", "failed"), ("c", "running")):
        store.log_run(kind, status, began, at(2024, 1, 10), "p7")
    return scans.latest_runs(store.run_log()).select("type", "status", text_day("cutoff").alias("cutoff"), "latest")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "csv")
    sinks.write_csv(tables(spark, sf_dir).pp.select("product", "template_product", "strength"), path, header=False)
    return scans.csv(spark, path).select("entity", "template", flat("strength").alias("strength"))


def frequencies_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of one half of the products and, signed, of the other: terms that come to 0 go."""
    t = tables(spark, sf_dir)
    terms = sinks.materialized(t.counted)
    half = lambda k: models.document_frequencies(terms.where(F.crc32(F.encode("product", "UTF-8")) % 2 == k))
    once = sinks.add_frequencies(half(0), half(1))
    return sinks.add_frequencies(once, half(1).withColumn("df", -F.col("df"))).unionByName(half(1)).groupBy("language", "term").agg(F.sum("df").alias("df"))


def saved_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = lambda kind: F.lit(None).cast(kind)
    rows = tables(spark, sf_dir).summary.withColumns({"pp_latest_type": blank("string"), "pp_latest_date": blank("timestamp")})
    done = rows.where(F.col("activity") == "purchase").select("user", "product")
    return sinks.save_marks(rows, done, "pp").select("user", "product", "pp_latest_type", F.unix_micros("pp_latest_date").cast("string").alias("pp_latest_date"))


def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = testdata.read(spark, sf_dir, "documents").where("lang = 'en' AND text IS NOT NULL")
    words = text.tokenize(text.squeezed(F.col("text")))
    rows = docs.select("doc_id", words.alias("words"), text.remove_stop_words(words, F.lit("en"), text.MIN_LENGTH).alias("kept"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n"), F.size("kept").cast("long").alias("kept"), F.array_join("kept", " ").alias("words"))


def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("event_id") % 5 == 0, F.lit("no date")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = testdata.read(spark, sf_dir, "events").select("event_id", scalars.parse_date(written, "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    return rows.select("event_id", F.unix_micros("at").alias("at"), F.size(scalars.date_series(F.lit(at(2024, 1, 1)), F.col("at"))).cast("long").alias("days"))


def list_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = testdata.read(spark, sf_dir, "documents").select("doc_id", F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 12).alias("w"))
    a, b = docs.select(F.col("doc_id").alias("a"), F.col("w").alias("x")), docs.select(F.col("doc_id").alias("b"), F.col("w").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", flat(scalars.similar_list(F.col("x"), F.col("y"))).alias("list"))


def flat_and_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = testdata.read(spark, sf_dir, "part").select("p_partkey", F.struct("p_name", F.struct("p_size", "p_type").alias("more")).alias("about"))
    there = models.flattened(part)
    back = models.flattened(models.nested(there))
    return back.select("p_partkey", *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in back.columns if c != "p_partkey"])


def updated_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products changed since the last successful run, and all of them for a kind that never ran."""
    log = spark.createDataFrame([("terms", at(2024, 1, 10), "success"), ("terms", at(2024, 1, 20), "success"), ("terms", at(2024, 1, 25), "failed")], "type string, timestamp timestamp, status string")
    products = testdata.products(spark, sf_dir)
    part = lambda kind: lanes.since_last_run(products, log, kind, "date").select(F.lit(kind).alias("kind"), "external_id")
    return part("terms").unionByName(part("never"))


def newest(t: plans.Tables, ask: plans.Ask) -> DataFrame:
    """A specialist of one's own: the newest products for everyone."""
    dates = t.models.select(F.col("external_id").alias("product"), F.unix_seconds("date").cast("double").alias("s"))
    top = dates.orderBy(F.desc("s"), F.desc("product")).limit(ask.candidates)
    return plans.beside(ask.users, top.select("product", F.array("s").alias("score")))


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans.register("Newest", newest)
    try:
        return recommended("Newest")(spark, sf_dir)
    finally:
        del plans.SPECIALISTS["Newest"]


def bloom_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of values that aren't elements, whether the share taken for elements is near what theory says (within 5 points) and above none."""
    users = testdata.read(spark, sf_dir, "events").select("user_id").distinct()
    n, bits = users.count(), 1024
    others = spark.range(10_000_000, 10_020_000).withColumnRenamed("id", "user_id")
    share = bloom.BloomFilter(users, "user_id", bits, n).accepts(others, "user_id").agg(F.avg(F.col("accepted").cast("double")).alias("share"))
    expected = bloom.false_positive_share(bits, n, 20_000 + n) * (20_000 + n) / 20_000
    return share.select((F.abs(F.col("share") - expected) <= 0.05).alias("as_expected"), (F.col("share") < 1).alias("below_one"))


def ab_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abtest.reliability(abtest.simulated(spark, 10_000, 200, 7, 1.0, 0.1, 20_000), 0.1, 0.05)


def sparse_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = summaries.activity_summary(testdata.sparse_activities(spark, sf_dir), CONFIG)
    return summaries.popularity(summary, CONFIG).select("p_id", "count")


def queries() -> dict[str, Query]:
    day = lambda c: text_day(c).alias(c)
    return {
        "popularity": popular_top,
        "scan_users": lambda s, d: scans.user_ids(testdata.users(s, d)),
        "scan_products": lambda s, d: scans.products(testdata.products(s, d).where(F.col("deleted_on").isNull()), fields=["category", "price"], required=["category"], least=at(2024, 1, 11), most=at(2024, 1, 31)),
        "scan_deleted_products": lambda s, d: scans.product_ids(testdata.products(s, d), ids=["p1", "p16", "p33", "p34", "p999999"], allow_deleted=True),
        "scan_activity_summaries": lambda s, d: scans.activity_summaries(tables(s, d).summary, users=["u0", "u1", "u2", "hmrtmp9"], types=["purchase", "click"], least_day=at(2024, 1, 5)).select("user", "product", "activity", day("day")),
        "latest_activity_day": lambda s, d: scans.latest_activity_day(tables(s, d).summary).select("user", day("day")),
        "scan_impressions": lambda s, d: scans.impression_summaries(tables(s, d).impression_summary, products=["p1", "p2", "p3"], by_product=True).withColumn("first", F.unix_micros("first")),
        "impression_pairs": lambda s, d: scans.impression_pairs(tables(s, d).impression_summary, "p_id", ["p4", "p5"]),
        "date_filtered_products": lambda s, d: scans.date_filtered(testdata.products(s, d), at(2024, 1, 20), "date", "expiration_date"),
        "table_counts": lambda s, d: scans.counts(testdata.users(s, d), testdata.products(s, d), tables(s, d).models.select("external_id")),
        "popular_products": lambda s, d: scans.popular(tables(s, d).popularity, 20, least_day=at(2024, 1, 20)).select("p_id", flat("popularity").alias("popularity")),
        "raw_activities": lambda s, d: scans.raw_activities(testdata.activities(s, d), ["purchase", "signup"], at(2024, 1, 10), at(2024, 1, 12)).select("user", "product", "activity", F.unix_micros("created_at").alias("created_at")),
        "raw_impressions": lambda s, d: scans.raw_impressions(testdata.impressions(s, d), 500, at(2024, 1, 20)).select("user", "product", "event_id"),
        "anonymous_users": lambda s, d: all_users(s, d).where(scans.anonymous("user", CONFIG.anonymous_prefix)),
        "activity_summary": lambda s, d: summary_rows(tables(s, d).summary),
        "impression_summary": lambda s, d: impression_rows(tables(s, d).impression_summary),
        "popularity_summary": lambda s, d: popularity_rows(tables(s, d).popularity),
        "sparse_popularity": sparse_popularity,
        "rating_histogram": lambda s, d: summaries.rating_histogram(tables(s, d).named_summary, CONFIG),
        "products_by_rating": lambda s, d: summaries.by_rating(tables(s, d).named_summary, CONFIG, "user", "product").select("user", "rating", F.size("products").cast("long").alias("n"), F.array_min("products").alias("first"), F.array_max("products").alias("last")),
        "users_by_rating": lambda s, d: summaries.by_rating(tables(s, d).named_summary, CONFIG, "product", "user").select("product", "rating", F.size("users").cast("long").alias("n"), F.array_min("users").alias("first"), F.array_max("users").alias("last")),
        "uu_strengths": lambda s, d: strength_rows(tables(s, d, keep=True).uu, "user"),
        "pp_strengths": lambda s, d: strength_rows(tables(s, d, keep=True).pp, "product"),
        "uu_strengths_impressions": with_impressions("user"),
        "pp_strengths_impressions": with_impressions("product"),
        "user_templates": lambda s, d: template_rows(tables(s, d, keep=True).user_templates, "user"),
        "product_templates": lambda s, d: template_rows(tables(s, d, keep=True).product_templates, "product"),
        "allowed_product_templates": lambda s, d: template_rows(templates.product_templates(tables(s, d, keep=True).pp, CONFIG, templates.allowed_now(testdata.products(s, d), CONFIG), named(s, "external_id", "p1", "p2")), "product"),
        "recent_activities": lambda s, d: tables(s, d).recent.select("user", "product", "activity", day("day")),
        "recent_products": lambda s, d: ranking.recent_products(tables(s, d).recent, CONFIG).select("user", F.col("base_rank").cast("int").alias("base_rank"), "product"),
        "template_activities": lambda s, d: ranking.template_activities(tables(s, d).named_summary, CONFIG).select("user", "product", scalars.by_activity(F.col("activity"), CONFIG, "out_boost").alias("out_boost")),
        "blocked_products": lambda s, d: tables(s, d).blocked,
        "decays": decay_values,
        "whole_days": lambda s, d: testdata.read(s, d, "events").select("event_id", scalars.whole_days(F.lit(at(2024, 1, 15, 12, 30)), F.col("ts").cast("timestamp")).alias("days")),
        "similarities": similarity_values,
        "tokens": token_rows,
        "common_terms": common_words,
        "term_frequencies": lambda s, d: tables(s, d).terms.select("product", "attribute", "term", "count"),
        "document_frequencies": lambda s, d: models.document_frequencies(tables(s, d).terms),
        "tfidf": lambda s, d: tables(s, d).tfidf.select("product", "attribute", "term", flat("tfidf").alias("tfidf")),
        "content_strengths": lambda s, d: tables(s, d, keep=True).content.select("product", "template_product", F.round("strength", 6).alias("strength")),
        "content_templates": lambda s, d: template_rows(tables(s, d, keep=True).content_templates, "product"),
        "stemmed_models": lambda s, d: models.persisted(models.product_models(testdata.products(s, d), EngineConfig()), EngineConfig()),
        "stemmed_terms": lambda s, d: models.term_frequencies(testdata.products(s, d), EngineConfig()),
        "scan_models": lambda s, d: scans.checked(tables(s, d).models.select("external_id", "category", "price"), 10_000_000),
        "models_sharing_terms": lambda s, d: scans.models_sharing_terms(tables(s, d).models.withColumnRenamed("external_id", "product"), tables(s, d).tfidf, "full_content", "x-en", ["the", "of", "and"]).select(F.col("product").alias("external_id")),
        "scan_uu_strengths": lambda s, d: strength_rows(scans.strengths(tables(s, d).uu, "user", ["u1", "u2", "u3"]), "user"),
        "scan_pp_strengths": lambda s, d: strength_rows(scans.strengths(tables(s, d).pp, "product", None, ["p1", "p2"]), "product"),
        "scan_content_strengths": lambda s, d: scans.strengths(content_of(s, d, ["p1", "p2"]), "product", ["p1", "p2"], None, True).select("product", "template_product", F.round("strength", 6).alias("strength")),
        "scan_uu_operands": lambda s, d: scans.operands(tables(s, d).uu, "user", ["u1", "u2"], None),
        "scan_pp_operands": lambda s, d: scans.operands(tables(s, d).pp, "product", ["p5"], None),
        "scan_document_frequency": lambda s, d: scans.document_frequency(models.document_frequencies(tables(s, d).terms), "x-en", named(s, "term", "the", "and", "nowhere")),
        "scan_templates": cached_templates,
        "latest_runs": run_log,
        "csv_round_trip": csv_round_trip,
        "upsert_templates": upserted_templates,
        "store_swap": swapped,
        "add_frequencies": frequencies_added,
        "save_marks": saved_marks,
        "distinct_sample": lambda s, d: scans.distinct_sample(tables(s, d).summary, "product", 25),
        "stop_words": stop_words,
        "parsed_dates": parsed_dates,
        "list_similarities": list_similarities,
        "flat_and_nested": flat_and_nested,
        "updated_products": updated_products,
        "registered_specialist": registered,
        "bloom_false_positives": bloom_false_positives,
        "streaming_delete": streamed_delete,
        "streaming_user_templates": streamed_templates,
        "streaming_expiry": streamed_expiry,
        "context_filter": context('{"$or": [{"language": "x-en", "price": {"$lt": 1500}}, {"language": {"$ne": "x-en"}, "date": {"$gte": "2024-01-21T00:00:00+00:00"}}]}'),
        "context_filter_list": context('{"source": "src3", "$and": [{"price": {"$gte": 100}}]}'),
        "near_identical": near_identical_rows,
        "recommend_pop": recommended("POP"),
        "recommend_ubcf": recommended("UBCF"),
        "recommend_pbcf": recommended("PBCF"),
        "recommend_cb": recommended("CB"),
        "recommend_random": recommended("Random"),
        "voting_scores": voting_scores,
        "hybrid_chunks": hybrid("HRChunks"),
        "hybrid_random": hybrid("HRRandom"),
        "hybrid_voting": hybrid("HRVoting"),
        "hybrid_voting_impressions": hybrid("HRVoting", impressions=True),
        "hybrid_chunks_before_scoring": hybrid("HRChunks", filter_strategy="BEFORE_SCORING"),
        "batch_recommend": lambda s, d: sinks.wide_recommendations(merged(s, d, "HRVoting"), 10),
        "merge_operands": operands_merged,
        "upsert_strengths": upserted,
        "increment_operands": incremented,
        "delete_products": lambda s, d: sinks.delete(testdata.products(s, d), named(s, "external_id", "p3", "p4"), "external_id").select("external_id"),
        "mark_deleted": lambda s, d: sinks.mark_deleted(testdata.products(s, d), named(s, "external_id", "p3", "p16"), at(2024, 1, 30)).select("external_id", text_day("deleted_on").alias("deleted_on")),
        "copy_marks": marks,
        "expire_anonymous": lambda s, d: sinks.expire(testdata.activities(s, d), at(2024, 1, 25), 10).select("user", "product", F.unix_micros("created_at").alias("created_at")),
        "sample_users": lambda s, d: scans.sample_users(testdata.users(s, d), 10, 5),
        "bloom_filter": bloom_members,
        "ab_reliability": ab_reliability,
        "ab_posterior": lambda s, d: abtest.gain_posterior(s, 10_000, 200, 7, 1.0, 0.1),
        "streaming_activity_summary": lambda s, d: summary_rows(streamed("summary")(s, d)),
        "streaming_impression_summary": lambda s, d: impression_rows(streamed("impressions")(s, d)),
        "streaming_popularity": lambda s, d: popularity_rows(streamed("popularity")(s, d)),
        "streaming_uu_strengths": lambda s, d: strength_rows(streamed("user")(s, d), "user"),
        "streaming_pp_strengths": lambda s, d: strength_rows(streamed("product")(s, d), "product"),
        "streaming_terms": streamed_terms,
    }
