"""Product models and term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflux.config import EngineConfig
from recoflux.functions import text

#: Frequencies of the most common terms that are sent to all tasks.
FREQUENT = 1 << 17


def required_fields(config: EngineConfig) -> Column:
    """That every required attribute without a default is there."""
    out = F.lit(True)
    for a in config.attributes:
        if a.required and not a.default:
            out = out & F.col(a.path).isNotNull()
    return out


def product_models(products: DataFrame, config: EngineConfig, stemmed: bool = True) -> DataFrame:
    """Declared attributes, defaulted and typed, of the products that have all required ones; text becomes stems."""
    language = config.attribute("language")
    rows = products.where(required_fields(config))
    language = F.coalesce(F.col(language.path), F.lit(language.default))
    out = [F.col("external_id")]
    for a in config.attributes:
        value = F.col(a.path)
        if a.kind == "text":
            value = text.text_to_stems(value, language) if stemmed else text.remove_stop_words(text.tokenize(text.squeezed(value)), language, text.MIN_LENGTH)
        elif a.kind == "date":
            value = value.cast("timestamp")
        elif a.kind == "numeric":
            value = value.cast("double")
        if a.kind != "text" and a.default is not None:
            value = F.coalesce(value, F.lit(a.default))
        out.append(value.alias(a.name))
    return rows.select(*out)


def persisted(models: DataFrame, config: EngineConfig) -> DataFrame:
    return models.select("external_id", *[a.name for a in config.attributes if a.persisted])


def flattened(df: DataFrame, prefix: str = "") -> DataFrame:
    """Nested columns as columns with dotted names."""
    from pyspark.sql import types as T

    def walk(kind: T.StructType, path: str, name: str):
        for f in kind.fields:
            p, n = (f"{path}.`{f.name}`" if path else f"`{f.name}`"), (f"{name}.{f.name}" if name else f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, p, n)
            else:
                yield F.col(p).alias(n)

    return df.select(*walk(df.schema, "", prefix))


def nested(df: DataFrame) -> DataFrame:
    """Columns with dotted names as nested columns."""
    tree: dict = {}
    for name in df.columns:
        at = tree
        *path, leaf = name.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[leaf] = F.col(f"`{name}`")

    def build(node: dict):
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return df.select(*build(tree))


def counted_terms(products: DataFrame, config: EngineConfig, stemmed: bool = True) -> DataFrame:
    """(product, language, attribute, term, count, first) over all text attributes of products that make a model; first is true of one of
    a product's rows of a term.

    Texts are brought together by product before they are cut, and terms are counted in sorted lists of a product's words; words aren't
    shuffled. That takes more time than term_frequencies() and less disk.
    """
    declared, texts = config.attribute("language"), config.of_kind("text")
    language = F.coalesce(F.col(declared.path), F.lit(declared.default))
    rows = products.where(required_fields(config)).where(language.isNotNull())
    rows = rows.select(F.col("external_id").alias("product"), language.alias("language"), *[F.col(a.path).alias(f"_{k}") for k, a in enumerate(texts)]).repartition("product")
    rows = rows.groupBy("product", "language").agg(*[F.concat_ws(" ", F.collect_list(f"_{k}")).alias(f"_{k}") for k in range(len(texts))])
    marked = lambda k: lambda w: F.struct(w.alias("term"), F.lit(k).alias("k"))
    words = [F.transform(text.terms(F.col(f"_{k}"), F.col("language"), stemmed), marked(k)) for k in range(len(texts))]
    rows = rows.select("product", "language", F.sort_array(F.concat(*words)).alias("w")).where(F.size("w") > 0)
    at = lambda i: F.get("w", i)
    new_term = lambda i: (i == 0) | (at(i)["term"] != at(i - 1)["term"])
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: new_term(i) | (at(i)["k"] != at(i - 1)["k"]))
    rows = rows.withColumn("starts", starts)
    item = lambda i, j: F.struct(at(i)["k"].alias("k"), at(i)["term"].alias("term"), (F.coalesce(F.get("starts", j + 1), F.size("w")) - i).cast("long").alias("count"), new_term(i).alias("first"))
    rows = rows.select("product", "language", F.explode(F.transform("starts", item)).alias("x"))
    return rows.select("product", "language", F.get(F.array(*[F.lit(a.name) for a in texts]), F.col("x.k")).alias("attribute"), "x.term", "x.count", "x.first")


def term_frequencies(products: DataFrame, config: EngineConfig, stemmed: bool = True) -> DataFrame:
    """(product, language, attribute, term, count) over all text attributes of products that make a model."""
    declared = config.attribute("language")
    language = F.coalesce(F.col(declared.path), F.lit(declared.default))
    rows = products.where(required_fields(config)).where(language.isNotNull())
    texts = F.array(*[F.struct(F.lit(a.name).alias("attribute"), F.col(a.path).alias("text")) for a in config.of_kind("text")])
    rows = rows.select(F.col("external_id").alias("product"), language.alias("language"), F.explode(texts).alias("t")).select("product", "language", "t.attribute", "t.text").where(F.col("text").isNotNull())
    rows = rows.select("product", "language", "attribute", F.explode(text.terms(F.col("text"), F.col("language"), stemmed)).alias("term"))
    return rows.groupBy("product", "language", "attribute", "term").agg(F.count(F.lit(1)).alias("count"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """Products per (language, term), whatever the attribute: two plain aggregations instead of a distinct count."""
    if "first" in tf.columns:
        return tf.where("first").groupBy("language", "term").agg(F.count(F.lit(1)).alias("df"))
    return tf.select("language", "term", "product").distinct().groupBy("language", "term").agg(F.count(F.lit(1)).alias("df"))


def tf_idf(tf: DataFrame, df: DataFrame, total: int | Column, k: int) -> DataFrame:
    """The k terms of the highest normalised tf-idf above 0 of each (product, attribute); ties go to the larger term.

    tf / max(tf) * ln(total / (1 + df)), over the product's largest. total counts all products of the batch.
    """
    of = Window.partitionBy("product", "attribute")
    total = total if isinstance(total, Column) else F.lit(total)
    keys = ["language", "term"]
    often = df.orderBy(F.desc("df"), *keys).limit(FREQUENT).withColumnRenamed("df", "_df")
    both = tf.join(F.broadcast(often), keys, "left")  # only rows of rarer terms go to their frequency by a shuffle
    rows = both.where(F.col("_df").isNotNull()).withColumnRenamed("_df", "df").unionByName(both.where(F.col("_df").isNull()).drop("_df").join(df, keys))
    rows = rows.withColumn("raw", F.col("count") / F.max("count").over(of) * F.log(total / (1 + F.col("df"))))
    rows = rows.withColumn("most", F.max("raw").over(of)).where((F.col("most") > 0) & (F.col("raw") > 0))
    rows = rows.withColumn("tfidf", F.col("raw") / F.col("most"))
    place = F.row_number().over(of.orderBy(F.desc("tfidf"), F.desc("term")))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("product", "language", "attribute", "term", "tfidf")
