"""Content similarity of products by shared terms and other attributes."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflux.config import Attribute, EngineConfig
from recoflux.functions import text
from recoflux.sources import sinks


#: Products of a block, as targets and as templates; a task holds one of each and their scores (at most 8 * 1024 * 4096 bytes).
TARGETS, TEMPLATES = 1024, 4096
MICROS_A_DAY = 86_400_000_000


def product_rows(tfidf: DataFrame, models: DataFrame, config: EngineConfig) -> DataFrame:
    """One row per product: language, its terms with weights (names begin with the attribute's number) and the attributes that count."""
    texts = text_weights(config)
    used = [a for a in config.attributes if (a.similarity_weight > 0 and a.kind != "text") or (a.similarity_filter and a.name != "language")]
    number = reduce(lambda c, x: c.when(F.col("attribute") == x[1], F.lit(str(x[0]))), enumerate(texts), F.when(F.lit(False), F.lit("")))
    rows = tfidf.where(F.col("attribute").isin(list(texts))).select("product", "language", F.struct(F.concat_ws(":", number, "term").alias("term"), "tfidf").alias("t"))
    rows = rows.groupBy("product", "language").agg(F.sort_array(F.collect_list("t")).alias("t"))  # top_terms of each attribute at most
    values = [F.unix_micros(a.name).alias(f"_{a.name}") if a.kind == "date" else F.col(a.name).alias(f"_{a.name}") for a in used]
    rows = rows.join(models.select(F.col("external_id").alias("product"), *values), "product")
    return rows.select("product", "language", F.col("t.term").alias("terms"), F.col("t.tfidf").alias("weights"), *[f"_{a.name}" for a in used])


def text_weights(config: EngineConfig) -> dict[str, float]:
    return {a.name: a.similarity_weight for a in config.of_kind("text") if a.similarity_weight > 0}


def entries(rows: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, weight) of all terms of rows."""
    terms, weights = (rows.column(c).combine_chunks() for c in ("terms", "weights"))
    return np.repeat(np.arange(len(rows)), terms.value_lengths().to_numpy()), terms.flatten(), weights.flatten().to_numpy()


def text_scores(targets: pa.Table, templates: pa.Table, weights: list[float]) -> np.ndarray:
    """The weighted similarity of the texts of every target with every template.

    Of an attribute, sim(p -> t) = sum over shared terms of w_p / sum(w_p) * (1 - max(0, w_p - w_t)): what p's weights
    say, less where t has a term with less weight. Term by term, the targets that have it are added up with the templates that have it.
    """
    p, name_p, w_p = entries(targets)
    t, name_t, w_t = entries(templates)
    codes = pa.chunked_array([name_p, name_t]).combine_chunks().dictionary_encode().indices.to_numpy()
    code_p, code_t = codes[: len(p)], codes[len(p) :]
    attribute = np.array([int(x.split(":", 1)[0]) for x in name_p.to_pylist()], np.int64)
    of = p * len(weights) + attribute
    share = w_p / np.bincount(of, w_p)[of] * np.array(weights)[attribute] if len(p) else w_p
    scores = np.zeros((len(targets), len(templates)))
    by_p, by_t = np.argsort(code_p, kind="stable"), np.argsort(code_t, kind="stable")
    shared = np.intersect1d(code_p, code_t)
    edges = [np.searchsorted(c[by], shared, side).tolist() for c, by in ((code_p, by_p), (code_t, by_t)) for side in ("left", "right")]
    for a, b, c, d in zip(*edges):
        x, y = by_p[a:b], by_t[c:d]
        scores[p[x][:, None], t[y]] += share[x][:, None] * (1 - np.maximum(0, w_p[x][:, None] - w_t[y]))
    return scores


def attribute_scores(a: Attribute, x: pa.Array, y: pa.Array, config: EngineConfig) -> np.ndarray:
    """The similarity of an attribute that isn't text, of all of x (rows) with all of y; 0 where there is none."""
    if a.kind == "list":
        own, other = ([None if v is None else set(v) for v in side.to_pylist()] for side in (x, y))
        posted: dict = {}
        for j, values in enumerate(other):
            for v in values or ():
                posted.setdefault(v, []).append(j)
        out = np.zeros((len(x), len(y)))
        for i, values in enumerate(own):
            if values is not None and not values:
                out[i] = 1.0
            for v in values or ():
                out[i, posted.get(v, [])] += 1 / len(values)
        return out
    if a.kind == "fixed":
        codes = pa.chunked_array([x, y]).combine_chunks().dictionary_encode().indices
        codes = codes.fill_null(-1).to_numpy()
        one, two = codes[: len(x)][:, None], codes[len(x) :][None, :]
        return ((one == two) & (one >= 0)).astype(float)
    one, two = (side.cast(pa.float64()).to_numpy(zero_copy_only=False) for side in (x, y))
    one, two = one[:, None], two[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        low, high = np.minimum(one, two), np.maximum(one, two)
        if a.kind == "numeric":
            out = np.where((low == 0) & (high == 0), 1.0, low / high)
            out[high == 0] = np.where(low[high == 0] == 0, 1.0, 0.0)
        elif config.date_halflife is None:
            out = np.ones(low.shape)
        else:
            out = 2.0 ** (-np.floor((high - low) / MICROS_A_DAY) / config.date_halflife)
    return np.nan_to_num(out)


def content_strengths(tfidf: DataFrame, models: DataFrame, config: EngineConfig, targets: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """(product, template_product, strength): weighted similarities of all attributes of pairs of one language that share a term.

    Attributes declared as similarity filters must be equal. A sum below the least strength is 0. best: the
    so many strongest templates above 0 of each product alone, ties to the smaller id.

    Every product meets every other of its language whatever the terms, since most share some. They meet in
    blocks: a task takes the products of one block as targets and those of another as templates, adds up
    dense scores term by term and, with best, gives no more rows than that for each target. The number of blocks follows that of
    products of the language, so neither a common term nor a common language makes a task larger. With targets (a column
    product) the blocks are those of the targets, so each product is sent once for each 1024 targets of its language.
    """
    if config.tfidf_window is not None:
        fresh = models.where(F.col(config.date_attribute) >= F.lit(config.present) - F.make_interval(days=F.lit(config.tfidf_window))).select(F.col("external_id").alias("product"))
        tfidf = tfidf.join(fresh, "product", "left_semi")
    rows = product_rows(tfidf, models, config)
    asked = rows if targets is None else rows.join(targets.select("product").distinct(), "product", "left_semi")
    if targets is not None:
        rows, asked = sinks.materialized(rows), sinks.materialized(asked)
    split = lambda df, **sizes: df.groupBy("language").agg(*[F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"_{name}") for name, size in sizes.items()])
    if targets is None:
        sizes = split(rows, targets=TARGETS, templates=TEMPLATES)
    else:
        sizes = split(asked, targets=TARGETS).join(split(rows, templates=TEMPLATES), "language")  # languages without a target have no blocks
    sized, asked = rows.join(F.broadcast(sizes), "language"), asked.join(F.broadcast(sizes), "language")  # a row for each language
    side = lambda df, mine, others, role: df.withColumns({f"_{mine}": F.pmod(F.xxhash64("product"), F.col(f"_{mine}s")).cast("int"), f"_{others}": F.explode(F.sequence(F.lit(0), F.col(f"_{others}s") - 1)), "_role": F.lit(role)})
    columns = [*rows.columns, "_target", "_template", "_role"]
    both = side(asked, "target", "template", 0).select(*columns).unionByName(side(sized, "template", "target", 1).select(*columns))
    weights = list(text_weights(config).values())
    used = [a for a in config.attributes if a.similarity_weight > 0 and a.kind != "text"]
    filters = [a for a in config.attributes if a.similarity_filter and a.name != "language"]

    def run(table: pa.Table) -> pa.Table:
        role = table.column("_role").to_numpy()
        mine, others = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
        names, templates = (side.column("product").to_pylist() for side in (mine, others))
        words = text_scores(mine, others, weights)
        own = {x: i for i, x in enumerate(templates)}
        for i, x in enumerate(names):
            if x in own:
                words[i, own[x]] = 0.0
        shared = words > 0
        scores = np.zeros(words.shape)
        for a in used:
            scores += attribute_scores(a, *(side.column(f"_{a.name}").combine_chunks() for side in (mine, others)), config) * a.similarity_weight
        scores = np.round(words + scores, 12)
        for a in filters:
            shared &= attribute_scores(replace(a, kind="fixed"), *(side.column(f"_{a.name}").combine_chunks() for side in (mine, others)), config) > 0
        scores[scores < config.min_strength] = 0.0
        i, j = np.nonzero(shared if best is None else shared & (scores > 0))
        if best is not None and len(i):
            place = np.empty(len(templates), np.int64)
            place[sorted(range(len(templates)), key=templates.__getitem__)] = np.arange(len(templates))
            by = np.lexsort((place[j], -scores[i, j], i))
            i, j = i[by], j[by]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < best
            i, j = i[keep], j[keep]
        take = lambda side, at: side.column("product").combine_chunks().take(pa.array(at))
        return pa.table({"product": take(mine, i), "template_product": take(others, j), "strength": scores[i, j]})

    parts = 4 * int(tfidf.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks are few and each is much work, so partitions aren't put together by size
    keys = ["language", "_target", "_template"]
    return both.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, "product string, template_product string, strength double")


def near_identical(ranked: DataFrame, models: DataFrame, config: EngineConfig, key: str = "user") -> DataFrame:
    """(key, product) of ranked (key, rank, product) that share too many stems with a product at most a page above it.

    A higher product counts even if it is itself a near-identical one. Rows are dealt by the key and blocks of 64 pages, with
    the last page of the block before, and meet those at most a page above them in a window.
    """
    stems = models.select(F.col("external_id").alias("product"), F.array_distinct(config.near_identical_field).alias("_stems"))
    rows = ranked.select(key, F.col("rank").cast("long").alias("rank"), "product").join(stems, "product")
    page = config.page_size
    size = page * 64 if page else None
    block = F.floor(F.col("rank") / size) if page else F.lit(0).cast("long")
    ends = F.col("rank") >= (block + 1) * size - page if page else F.lit(False)
    rows = rows.withColumn("_block", F.explode(F.when(ends, F.array(block, block + 1)).otherwise(F.array(block))))
    above = Window.partitionBy(key, "_block").orderBy("rank").rangeBetween(-page if page else Window.unboundedPreceding, -1)
    rows = rows.withColumn("_above", F.collect_list(F.struct("_stems")).over(above)).where(F.col("_block") == block)
    near = F.exists("_above", lambda x: text.common_terms(F.col("_stems"), x["_stems"]) > config.near_identical_threshold)
    return rows.where(near).select(key, "product").distinct()


def near_identical_pairs(pairs: DataFrame, models: DataFrame, config: EngineConfig, base: str = "base") -> DataFrame:
    """Of pairs (base, product), those whose product shares too many stems with its base."""
    stems = lambda who, name: models.select(F.col("external_id").alias(who), F.col(config.near_identical_field).alias(name))
    rows = pairs.select(base, "product").distinct().join(stems(base, "_x"), base).join(stems("product", "_y"), "product")
    return rows.where(text.common_terms(F.col("_x"), F.col("_y")) > config.near_identical_threshold).select(base, "product")
