"""Operators on small made tables: goldens, ties, quirks and edge cases."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from recoflux import schema
from recoflux.config import Activity, Attribute, EngineConfig
from recoflux.operators import abtest, content, filters, merging, models, ranking, strengths, summaries, templates
from recoflux.plans import recommend as plans
from recoflux.sources import scans, sinks
from recoflux.streaming import lanes

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
CONFIG = EngineConfig(near_identical_field=None)


def log(spark, rows):
    """(user, product, activity, hours before NOW)"""
    return spark.createDataFrame([(u, p, a, NOW - timedelta(hours=h), u.startswith("hmrtmp")) for u, p, a, h in rows], schema.ACTIVITIES)


def shown(spark, rows):
    return spark.createDataFrame([(u, p, NOW - timedelta(hours=h), False) for u, p, h in rows], schema.IMPRESSIONS)


def made_log(seed, n, users=8, products=8):
    r = random.Random(seed)
    kinds = ["purchase", "signup", "click", "error", "unheard-of"]
    hours = r.sample(range(1, 700), n)
    return [(f"{'hmrtmp' if k % 7 == 6 else 'u'}{k}", f"p{r.randrange(products)}", r.choice(kinds), h) for h in hours for k in [r.randrange(users)]]


def test_popularity_arithmetic(spark):
    of = lambda rows: {r.p_id: r.popularity for r in summaries.popularity(summaries.activity_summary(log(spark, rows), CONFIG), CONFIG).collect()}
    day = [("a", "p", "purchase", 1), ("b", "p", "purchase", 2), ("c", "p", "purchase", 3)]
    assert of(day)["p"] == 3
    day += [("d", "p", "purchase", 30)]
    assert of(day)["p"] == 2
    assert of(day + [("a", "p", "click", 1.5)])["p"] == 2
    assert of(day + [("a", "p", "purchase", -20)])["p"] == pytest.approx(4 / 3)


def test_impressions_count_after_the_last_activity(spark):
    acts = log(spark, [("a", "p", "click", 10), ("a", "p", "purchase", 5), ("b", "p", "unheard-of", 1)])
    imps = shown(spark, [("a", "p", 20), ("a", "p", 5), ("a", "p", 4), ("a", "p", 3), ("b", "p", 9), ("b", "q", 2)])
    out = {(r.u_id, r.p_id): (r["count"], r.first) for r in summaries.impression_summary(imps, acts, CONFIG).collect()}
    assert {k: v[0] for k, v in out.items()} == {("a", "p"): 2, ("b", "p"): 1, ("b", "q"): 1}


def test_strengths_against_plain_loops(spark):
    rows = made_log(3, 120)
    latest = {}
    for u, p, a, h in sorted(rows, key=lambda r: -r[3]):
        if a in CONFIG.activities and not u.startswith("hmrtmp"):
            latest[u, p] = CONFIG.activities[a].rating
    summary = summaries.activity_summary(log(spark, rows), CONFIG)
    for entity in (0, 1):
        roles = strengths.user_roles(CONFIG) if entity == 0 else strengths.product_roles(CONFIG)
        expected = {}
        for (u, p), x in latest.items():
            for (v, q), y in latest.items():
                me, you, same = ((u, v, p == q), (p, q, u == v))[entity]
                if same and me != you and x >= roles.target_rating and y >= roles.template_rating:
                    nc, na = expected.get((me, you), (0, 0))
                    expected[me, you] = nc + 1, na + ((x if entity == 0 else y) >= 5)
        found = {(r[0], r[1]): r for r in strengths.strengths(summary, roles, CONFIG).collect()}
        assert {k: (r.nc, r.na) for k, r in found.items()} == expected
        for (me, you), r in found.items():
            den = sum(1 for (u, p), x in latest.items() if (u == you and x >= 4 if entity == 0 else p == me and x >= 3))
            assert r.denominator == den
            assert r.strength == pytest.approx((r.na * 0.8 + r.nc * 0.2) / den)


@pytest.mark.parametrize("cell", [1, 2, 7])
def test_pairs_of_an_item_that_all_share_are_made_in_cells(spark, monkeypatch, cell):
    rows = spark.createDataFrame([(f"u{k}", p, 3 + k % 3) for k in range(23) for p in ("all", f"own{k % 4}")], "user string, product string, rating int")
    pairs = lambda roles: sorted(tuple(r) for r in strengths.numerators(rows, roles, CONFIG).collect())
    both = [strengths.user_roles(CONFIG), strengths.product_roles(CONFIG)]
    whole = [pairs(roles) for roles in both]
    monkeypatch.setattr(strengths, "CELL", cell)
    assert [pairs(roles) for roles in both] == whole
    left, right = rows.select("product", "user"), rows.select("product", F.col("user").alias("template_user"))
    left, right, key = strengths.gridded(left, right, both[0], cell)
    made = left.join(right, key).where("product = 'all'").groupBy(*key).count().collect()
    assert sum(r["count"] for r in made) == 23 * 23 and len(made) > 1


def test_template_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([("a", "z", 0.5), ("a", "b", 0.5), ("a", "c", 0.9), ("a", "d", 0.0)], "user string, template_user string, strength double")
    assert [(r.place, r.template_user) for r in templates.top(rows, "user", 2).orderBy("place").collect()] == [(1, "c"), (2, "b")]
    cache = templates.cached(templates.top(rows, "user", 5), "user")
    assert [t.id for t in cache.first().templates] == ["c", "b", "z"]
    assert [(r.place, r.template) for r in scans.templates_of(cache, ["a"]).orderBy("place").collect()] == [(1, "c"), (2, "b"), (3, "z")]


def test_rank_ties_go_to_the_larger_id(spark):
    rows = spark.createDataFrame([("a", "p", [1.0]), ("a", "q", [1.0]), ("a", "r", [1.0, 2.0])], "user string, product string, score array<double>")
    assert [r.product for r in ranking.ranked(rows).orderBy("rank").collect()] == ["r", "q", "p"]


def test_csv_merge(spark, tmp_path):
    parts = {
        "numerators": "user1,product1,10,1\nuser1,product2,20,2\nuser1,product3,30,1\nuser2,product1,100,10\nuser2,product4,100,50\n\n",
        "denominators": "user1,product1,10\nuser1,product2,20\nuser1,product3,35\nuser2,product2,110\nuser2,product4,200\nuser2,product5,500\n",
        "strengths": "user1,product2,0.2\nuser1,product3,0.35\nuser2,product2,0.11\nuser2,product4,0.2\nuser2,product5,0.5\n",
    }
    kinds = {"numerators": schema.CSV_NUMERATORS, "denominators": schema.CSV_DENOMINATORS, "strengths": schema.CSV_STRENGTHS}
    for name, lines in parts.items():
        (tmp_path / f"{name}.csv").write_text(lines)
    merged = merging.merge_operands(*[scans.csv(spark, str(tmp_path / f"{n}.csv"), kinds[n]) for n in parts])
    sinks.write_csv(merged.coalesce(1).orderBy("entity", "template"), str(tmp_path / "out"), header=False)
    text = next((tmp_path / "out").glob("part*")).read_text()
    assert text.split() == "user1,product1,10,1,10, user1,product2,20,2,20,0.2 user1,product3,30,1,35,0.35 user2,product1,100,10,, user2,product2,,,110,0.11 user2,product4,100,50,200,0.2 user2,product5,,,500,0.5".split()


def test_context_filter(spark):
    rows = spark.createDataFrame([("p1", "en", ["a", "b"], 10.0, NOW), ("p2", "fr", ["a"], 20.0, NOW - timedelta(days=9)), ("p3", "en", [], 30.0, NOW)], "external_id string, language string, source array<string>, price double, date timestamp")
    ids = lambda f: sorted(r.external_id for r in filters.filtered(rows, f, CONFIG).collect())
    assert ids(None) == ["p1", "p2", "p3"]
    assert ids('{"language": "en", "price": {"$gt": 10}}') == ["p3"]
    assert ids('{"source": "a"}') == ["p1", "p2"]
    assert ids('{"source": ["a"]}') == ["p2"]
    assert ids('{"$or": [{"price": {"$lte": 10}}, {"$and": [{"language": "fr"}, {"price": {"$ne": 1}}]}]}') == ["p1", "p2"]
    assert ids('{"date": {"$lt": "2024-01-25T00:00:00+00:00"}}') == ["p2"]
    for bad in ("{", "[1]", '{"colour": 1}', '{"price": {"$near": 1}}', '{"date": "yesterday"}', '{"$or": []}'):
        with pytest.raises(ValueError):
            filters.parse(bad, CONFIG)
    assert filters.canonical('{"b": 1, "a": 2}') == filters.canonical('{"a": 2,  "b": 1}')


def test_blocked_is_empty_without_blocking_types(spark):
    config = CONFIG.with_(activities={"click": Activity(3)})
    assert filters.blocked(log(spark, [("a", "p", "click", 1)]), config).count() == 0


def test_scan_quirks(spark):
    rows = spark.createDataFrame([("p1", None), ("p2", NOW - timedelta(days=9)), ("p3", NOW + timedelta(days=1))], "external_id string, deleted_on timestamp").withColumn("date", F.lit(NOW))
    ids = lambda **k: sorted(r.external_id for r in scans.product_ids(rows, **k).collect())
    assert ids() == ["p1"]
    assert ids(most=NOW) == ["p1", "p3"]
    assert ids(allow_deleted=True, ids=["p2"]) == ["p2"]
    with pytest.raises(ValueError):
        scans.activity_summaries(rows)
    with pytest.raises(ValueError):
        scans.popular(rows)
    assert scans.checked(rows, 3).count() == 3
    with pytest.raises(Exception, match="more than 2 rows"):
        scans.checked(rows, 2).collect()


def catalogue(spark, changes):
    base = {"language": "x", "category": "c", "source": ["a", "b", "c"], "title": "alpha beta gamma", "full_content": "one two three four", "price": 100.0}
    names = ["external_id", *base, "date", "expiration_date", "deleted_on"]
    rows = [(p, *({**base, **c}).values(), NOW, NOW, None) for p, c in changes.items()]
    kinds = "external_id string, language string, category string, source array<string>, title string, full_content string, price double, date timestamp, expiration_date timestamp, deleted_on timestamp"
    return spark.createDataFrame(rows, kinds).select(*names)


def test_content_similarity_by_attribute(spark):
    products = catalogue(spark, {"base": {}, "title": {"title": "delta epsilon"}, "source": {"source": ["a", "b"]}, "category": {"category": "d"}, "none": {"category": None}, "half": {"price": 50.0}, "other": {"language": "y"}, "apart": {"full_content": "five six"}})
    t = plans.Tables(CONFIG, None, None, products, stemmed=False)
    tf = models.term_frequencies(products, CONFIG, stemmed=False)
    weights = models.tf_idf(tf, models.document_frequencies(tf), 1000, 200)
    sim = {(r[0], r[1]): r[2] for r in content.content_strengths(weights, t.models, CONFIG).collect()}
    assert sim["base", "title"] == pytest.approx(0.9)
    assert sim["base", "source"] == pytest.approx(0.9 + 0.1 * 2 / 3)
    assert sim["source", "base"] == pytest.approx(1)
    assert sim["base", "category"] == sim["base", "none"] == pytest.approx(0.9)
    assert sim["base", "half"] == sim["half", "base"] == pytest.approx(0.95)
    assert ("base", "other") not in sim
    strict = CONFIG.with_(attributes=tuple(Attribute("category", "fixed", similarity_filter=True, similarity_weight=0.1) if a.name == "category" else a for a in CONFIG.attributes))
    assert ("base", "category") not in {(r[0], r[1]) for r in content.content_strengths(weights, t.models, strict).collect()}


def test_models_default_and_require(spark):
    products = catalogue(spark, {"a": {"price": None, "language": None}, "b": {"full_content": None}})
    rows = models.product_models(products, CONFIG).collect()
    assert [(r.external_id, r.price, r.language) for r in rows] == [("a", 100.0, "en")]
    nested = models.nested(products.select("external_id", F.col("title").alias("resources.title"), F.col("price").alias("resources.money.price")))
    assert nested.schema["resources"].dataType.fieldNames() == ["title", "money"]
    assert models.flattened(nested).columns == ["external_id", "resources.title", "resources.money.price"]


def test_near_identical_looks_a_page_up(spark):
    stems = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["x", "y", "z", "q"]), ("c", ["k"]), ("d", ["x", "y", "z"])], "external_id string, title array<string>")
    ranks = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 3, "c"), ("u", 14, "d"), ("v", 1, "d")], "user string, rank int, product string")
    config = CONFIG.with_(near_identical_field="title", near_identical_threshold=2, page_size=10)
    assert {(r.user, r.product) for r in content.near_identical(ranks, stems, config).collect()} == {("u", "b")}
    assert {(r.user, r.product) for r in content.near_identical(ranks, stems, config.with_(page_size=None)).collect()} == {("u", "b"), ("u", "d")}
    rows = ranks.where("user = 'u'").withColumns({"score": F.array(F.lit(1.0)), "tags": F.array().cast("array<string>")})
    t = plans.Tables(config, None, None, None, stored={"models": stems})
    out = plans.without_near_identical(rows, t, 3).orderBy("rank").collect()
    assert [(r.product, list(r.tags)) for r in out] == [("a", []), ("c", []), ("d", [])]
    assert [list(r.tags) for r in plans.without_near_identical(rows, t, 4).orderBy("rank").collect()][3] == ["NI"]


def test_recommendations(spark):
    acts = log(spark, made_log(5, 200) + [("u9", "p1", "purchase", 3)])
    products = catalogue(spark, {f"p{k}": {"full_content": f"word{k} word{k % 3} shared"} for k in range(8)})
    t = plans.Tables(CONFIG, acts, shown(spark, []), products, stemmed=False)
    users = acts.select("user").distinct()
    blocked = {(r.user, r.product) for r in t.blocked.collect()}
    for algorithm in (*plans.SPECIALISTS, *plans.HYBRIDS):
        out = plans.recommend(t, users, 3, algorithm).collect()
        assert out and not {(r.user, r.product) for r in out} & blocked
        by_user = {}
        for r in out:
            by_user.setdefault(r.user, []).append((r["rank"], r.product))
        for found in by_user.values():
            assert sorted(k for k, _ in found) == list(range(1, len(found) + 1)) and len({p for _, p in found}) == len(found) <= 3
        if algorithm == "UBCF":
            assert not any(u.startswith("hmrtmp") for u in by_user)
    only = plans.recommend(t, users, 3, "POP", '{"external": 1}'.replace("external", "price").replace("1", "100"))
    assert only.count() > 0
    assert plans.recommend(t, users, 3, "POP", '{"price": 7}').count() == 0
    first = plans.Tables(CONFIG.with_(filter_strategy="BEFORE_SCORING"), acts, shown(spark, []), products, stemmed=False)
    out = plans.recommend(first, users, 5, "HRChunks").groupBy("user").count().collect()
    assert {r["count"] for r in out} == {5} and len(out) == users.count()
    with pytest.raises(KeyError):
        plans.recommend(t, users, 3, "Unheard")
    plans.register("Mock", plans.mock)
    with pytest.raises(RuntimeError):
        plans.recommend(t, users, 3, "Mock")
    del plans.SPECIALISTS["Mock"]


def test_in_boost_multiplies_scores(spark):
    acts = [("a", "p1", "signup", 2), ("b", "p1", "click", 3), ("b", "p2", "click", 4), ("c", "p2", "click", 1)]
    products = catalogue(spark, {"p1": {}, "p2": {}})
    t = plans.Tables(CONFIG, log(spark, acts), shown(spark, []), products, stemmed=False)
    rows = plans.recommend(t, spark.createDataFrame([("a",), ("z",)], "user string"), 2, "POP").collect()
    score = {(r.user, r.product): r.score[0] for r in rows}
    assert score["a", "p1"] == pytest.approx(1.5 * score["z", "p1"]) and score["a", "p2"] == score["z", "p2"]


@pytest.mark.parametrize("seed, with_impressions", [(1, False), (2, True)])
def test_lanes_end_where_a_batch_run_does(spark, tmp_path, seed, with_impressions):
    config = CONFIG.with_(impressions=with_impressions)
    rows = made_log(seed, 90)
    r = random.Random(seed)
    seen = [(f"u{r.randrange(8)}", f"p{r.randrange(8)}", h) for h in r.sample(range(1, 700), 60)]
    r.shuffle(rows)  # late events
    lane = lanes.Lanes(lanes.Tables(spark, str(tmp_path / "tables"), 4), config)
    for k in range(3):
        lane.shown(shown(spark, seen[k::3]), k)
        batch = log(spark, rows[k::3])
        lane.fast(batch, k)
        lane.slow(batch, k)
    lane.fast(log(spark, rows[2::3]), 2)  # a batch that is tried again
    acts, imps = log(spark, rows), shown(spark, seen)
    t = plans.Tables(config, acts, imps, None)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(lane.summary(), t.summary)
    assert same(lane.impression_summary(), t.impression_summary)
    assert same(lane.popularity(), t.popularity)
    if not with_impressions:
        assert same(lane.strengths("user"), t.uu) and same(lane.strengths("product"), t.pp)
        best = {x.id: [y.id for y in x.templates] for x in templates.cached(t.user_templates, "user").collect()}
        assert {x.id: [y.id for y in x.templates] for x in lane.templates("user").collect() if x.templates} == best
    lane.expire(NOW, 10)
    kept = [x for x in rows if not (x[0].startswith("hmrtmp") and x[3] > 240)]
    assert same(lane.summary(), plans.Tables(config, log(spark, kept), imps, None).summary)


def test_lanes_after_a_crash(spark, tmp_path, monkeypatch):
    """a run that dies before or after any table is published, and is then tried again"""
    rows = [x for x in made_log(6, 80) if x[2] != "unheard-of"]  # that type isn't logged
    first, second = log(spark, rows[::2]), log(spark, rows[1::2])
    t = plans.Tables(CONFIG, log(spark, rows), None, None)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    publish = lanes.Tables.publish
    for step in range(2):
        lane = lanes.Lanes(lanes.Tables(spark, str(tmp_path / str(step)), 2), CONFIG)
        lane.fast(first, 0)
        before = sorted(map(tuple, lane.popularity().collect()))
        left = [step]

        def dies(self, *args, **more):
            if not left[0]:
                raise RuntimeError("lost")
            left[0] -= 1
            return publish(self, *args, **more)

        monkeypatch.setattr(lanes.Tables, "publish", dies)
        with pytest.raises(RuntimeError):
            lane.fast(second, 1)
        monkeypatch.setattr(lanes.Tables, "publish", publish)
        assert sorted(map(tuple, lane.popularity().collect())) == before
        lane.fast(second, 1)
        assert same(lane.summary(), t.summary) and same(lane.popularity(), t.popularity)
        monkeypatch.setattr(lanes.Tables, "rewrite_log", lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            lane.expire(NOW, 10)
        monkeypatch.undo()
        assert lane.activities().count() == len(rows)  # nothing of the log is lost
        lane.expire(NOW, 10)
        lane.fast(first, 0)  # a batch that was merged into the base isn't logged again
        kept = [x for x in rows if not (x[0].startswith("hmrtmp") and x[3] > 240)]
        assert lane.activities().count() == len(kept)


def test_a_product_of_all_users(spark):
    rows = [(f"u{k}", "p0", "click", 1 + k % 9) for k in range(300)] + [(f"u{k}", f"p{1 + k % 3}", "purchase", 2) for k in range(0, 300, 10)]
    t = plans.Tables(CONFIG, log(spark, rows), None, None)
    assert t.uu.count() == 30 * 9 and t.pp.count() == 6
    assert {(r.product, r.template_product): r.nc for r in t.pp.collect()}["p0", "p1"] == 10


def test_streaming_source(spark, tmp_path):
    rows = made_log(4, 40)
    for k in range(2):
        log(spark, rows[k::2]).write.parquet(str(tmp_path / f"in/{k}"))
    lane = lanes.Lanes(lanes.Tables(spark, str(tmp_path / "tables"), 4), CONFIG)
    stream = spark.readStream.schema(schema.ACTIVITIES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    lanes.start(stream, lane.fast, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(map(tuple, lane.summary().collect())) == sorted(map(tuple, plans.Tables(CONFIG, log(spark, rows), None, None).summary.collect()))


def test_products_by_batches(spark, tmp_path):
    lane = lanes.Lanes(lanes.Tables(spark, str(tmp_path), 4), CONFIG)
    products = catalogue(spark, {f"p{k}": {"full_content": f"a{k % 2} b{k} shared"} for k in range(6)})
    lane.products_of(products, 0, stemmed=False)
    lane.products_of(products.where("external_id IN ('p1', 'p2')"), 1, stemmed=False)
    lane.delete_products(spark.createDataFrame([("p5",)], "external_id string"))
    terms = models.term_frequencies(products.where("external_id <> 'p5'"), CONFIG, stemmed=False)
    weights = models.tf_idf(terms, models.document_frequencies(terms), 5, 200)
    rows = lambda df: sorted(map(tuple, df.select("product", "attribute", "term", F.round("tfidf", 9)).collect()))
    assert rows(lane.weights(5)) == rows(weights)


def test_store(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    with pytest.raises(KeyError):
        store.read("t")
    store.write("t", a)
    version = store.stage("t", a.limit(0))
    assert store.read("t").count() == 2  # staged, not published
    store.publish(t=version)
    assert store.read("t").count() == 0
    store.write("t", a)
    store.merge("t", spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), ["k"])
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert store.append("t", a).count() == 5
    started = datetime.now(timezone.utc)
    store.log_run("job", "running", started)
    store.log_run("job", "success", started)
    assert [r.status for r in scans.latest_runs(store.run_log()).collect()] == ["success"]
    updated = spark.createDataFrame([(1, started - timedelta(days=1)), (2, started + timedelta(days=1))], "id int, updated_at timestamp")
    assert [r.id for r in lanes.since_last_run(updated, store.run_log(), "job").collect()] == [2]
    assert lanes.since_last_run(updated, store.run_log(), "other").count() == 2


def test_sinks(spark):
    old = spark.createDataFrame([("en", "a", 2), ("en", "b", 1)], "language string, term string, df long")
    change = spark.createDataFrame([("en", "a", -1), ("en", "b", -1), ("en", "c", 1)], "language string, term string, df long")
    assert {r.term: r.df for r in sinks.add_frequencies(old, change).collect()} == {"a": 1, "c": 1}
    recs = spark.createDataFrame([("u", 1, "p"), ("u", 2, "q"), ("v", 1, "r")], "user string, rank int, product string")
    wide = sinks.wide_recommendations(recs, 2)
    assert wide.columns == ["USER", "PRODUCT_1", "PRODUCT_2"]
    assert sorted(map(tuple, wide.collect()), key=str) == [("u", "p", "q"), ("v", "r", None)]


def test_abtest(spark):
    rows = abtest.simulated(spark, 10_000, 200, 5, 1.0, 0.1, 2000)
    r = rows.agg(F.avg("buys_a").alias("a"), F.avg("buys_b").alias("b"), F.avg(F.col("won_a") + F.col("won_b") + F.col("drawn")).alias("days")).first()
    assert r.a == pytest.approx(500, rel=0.02) and r.b == pytest.approx(550, rel=0.02) and r.days == 5
    assert 0.5 < abtest.reliability(rows, 0.1, 0.05).first().reliability < 1
    p = abtest.gain_posterior(spark, 10_000, 200, 100, 1.0, 0.1, 0.0, 0.2, 0.05, 500).orderBy("actual").collect()
    assert sum(x.probability for x in p) == pytest.approx(1) and p[-1].accrued == pytest.approx(1)
    assert max(p, key=lambda x: x.probability).actual == pytest.approx(0.1)


def test_engine(spark, tmp_path):
    from recoflux.engine import Engine

    acts = log(spark, made_log(8, 100))
    products = catalogue(spark, {f"p{k}": {} for k in range(8)})
    store = sinks.Store(spark, str(tmp_path))
    engine = Engine(spark, CONFIG, acts, shown(spark, []), products, store=store, stemmed=False)
    assert engine.summarize_activities().count() == engine.tables.summary.count() > 0
    engine.summarize_popularities()
    engine.generate_user_templates()
    assert {r.type for r in store.run_log().collect()} >= {"summarize_activities", "user_strengths", "user_templates"}
    assert engine.batch_recommend(3, "POP").columns == ["USER", "PRODUCT_1", "PRODUCT_2", "PRODUCT_3"]
    assert engine.recommend(["u1"], 2, "PBCF").select("user").distinct().count() <= 1
    assert engine.filtered_products('{"price": 100}').count() == 8 and engine.cache_stats() == {"filters": 1}
    engine.clear_cache()
    assert engine.cache_stats() == {"filters": 0}
    store.log_run("user_templates", "running", datetime.now(timezone.utc))
    with pytest.raises(RuntimeError):
        engine.consolidate_user_templates()
    assert {r.term: r["count"] for r in engine.calculate_tf("english", "cook cooking").collect()} == {"cook": 2}


def test_user_strengths_in_blocks(spark, monkeypatch):
    """blocks of a few users give what the join gives, also of what was shown and of some targets; with best, the same templates"""
    r = random.Random(5)
    made = lambda n, kinds: [(f"u{r.randrange(40)}", f"p{r.randrange(9)}", r.choice(kinds), h) for h in r.sample(range(1, 700), n)]
    summary = sinks.materialized(summaries.activity_summary(log(spark, made(250, ["purchase", "signup", "click"])), CONFIG))
    imps = sinks.materialized(summaries.impression_summary(shown(spark, [(u, p, h) for u, p, _, h in made(200, ["view"])]), log(spark, []), CONFIG))
    some = spark.createDataFrame([("u1",), ("u2",), ("u33",), ("nobody",)], "user string")
    roles = strengths.user_roles(CONFIG)
    for name, value in (("TARGETS", 7), ("TEMPLATES", 6), ("SCORES", 20)):
        monkeypatch.setattr(strengths, name, value)
    for impressions, targets in ((None, None), (imps, None), (None, some), (imps, some)):
        of = lambda best=None: strengths.strengths(summary, roles, CONFIG, impressions, targets, best=best)  # noqa: E731, B023
        top = lambda rows: sorted(tuple(x) for x in templates.top(rows, "user", 3).collect())
        blocks, best = sorted(tuple(x) for x in of().collect()), top(of(3))
        with monkeypatch.context() as m:
            m.setattr(strengths, "ITEMS", 0)
            assert strengths.few_items(summary, roles) is None
            assert blocks == sorted(tuple(x) for x in of().collect()) and blocks
            assert best == top(of()) and best
        assert of(3).count() < len(blocks)


def test_counted_terms_of_repeated_products(spark):
    """rows of one product count together; of its rows of a term one is marked, and frequencies are those of a distinct count"""
    rows = [("a", "x-en", "b b c", "c d"), ("a", "x-en", "b", None), ("b", "x-en", None, "d d e! e!"), ("c", "x-de", "b", "b")]
    products = spark.createDataFrame([(p, lang, t or "", c, "k", ["s"], 1.0) for p, lang, t, c in rows], "external_id string, language string, title string, full_content string, category string, source array<string>, price double")
    products = products.withColumns({"date": F.lit(NOW), "expiration_date": F.lit(NOW), "full_content": F.coalesce("full_content", F.lit(""))})
    made = models.counted_terms(products, CONFIG, False)
    plain = models.term_frequencies(products, CONFIG, False)
    assert sorted(tuple(r) for r in made.drop("first").collect()) == sorted(tuple(r) for r in plain.collect())
    of = lambda tf: sorted(tuple(r) for r in models.document_frequencies(tf).collect())
    assert of(made) == of(plain) and ("x-en", "d", 2) in of(made)
    assert made.where("product = 'a' AND term = 'c'").count() == 2 and made.where("product = 'a' AND term = 'c' AND first").count() == 1


def test_random_sends_no_users_to_the_driver(spark):
    """each user takes many products; the rows made of users are joined by chunk, without a broadcast of them"""
    names = [f"p{k}" for k in range(30)]
    t = plans.Tables(CONFIG, log(spark, [("a", "p1", "purchase", 5)]), shown(spark, []), None, stored={
        "models": spark.createDataFrame([(p, NOW) for p in names], "external_id string, date timestamp"),
        "live_products": spark.createDataFrame([(p,) for p in names], "external_id string"),
    })
    ask = plans.Ask(spark.createDataFrame([("a",), ("b",)], "user string"), t.models.select("external_id"), 500, 30)
    rows = plans.at_random(t, ask)
    found = {u: {r["product"] for r in rows.where(F.col("user") == u).collect()} for u in ("a", "b")}
    assert found == {"a": set(names) - {"p1"}, "b": set(names)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
