"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


KINDS = {"STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType()}


def _of(columns: str) -> T.StructType:
    """A schema from "name KIND, ..."; kinds by name, so that no session is needed."""
    pairs = [c.split() for c in columns.split(", ")]
    return T.StructType([T.StructField(name, T.ArrayType(KINDS[kind[6:-1]]) if kind.startswith("ARRAY<") else KINDS[kind]) for name, kind in pairs])


USERS = _of("external_id STRING, anonymous BOOLEAN")
ACTIVITIES = _of("user STRING, product STRING, activity STRING, created_at TIMESTAMP, anonymous BOOLEAN")
IMPRESSIONS = _of("user STRING, product STRING, created_at TIMESTAMP, anonymous BOOLEAN")
SUMMARY = _of("user STRING, product STRING, activity STRING, day TIMESTAMP, created_at TIMESTAMP")
MARKED_SUMMARY = _of("user STRING, product STRING, activity STRING, day TIMESTAMP, created_at TIMESTAMP, contributed BOOLEAN, uu_latest_type STRING, uu_latest_date TIMESTAMP, pp_latest_type STRING, pp_latest_date TIMESTAMP")
IMPRESSION_SUMMARY = _of("u_id STRING, p_id STRING, count BIGINT, first TIMESTAMP")
POPULARITY = _of("p_id STRING, first TIMESTAMP, latest TIMESTAMP, count BIGINT, popularity DOUBLE")
UU_STRENGTHS = _of("user STRING, template_user STRING, nc BIGINT, na BIGINT, denominator BIGINT, strength DOUBLE")
PP_STRENGTHS = _of("product STRING, template_product STRING, nc BIGINT, na BIGINT, denominator BIGINT, strength DOUBLE")
TFIDF_STRENGTHS = _of("product STRING, template_product STRING, strength DOUBLE")
TEMPLATES = T.StructType([T.StructField("id", T.StringType()), T.StructField("templates", T.ArrayType(_of("strength DOUBLE, id STRING")))])
TERMS = _of("product STRING, language STRING, attribute STRING, term STRING, count BIGINT")
DF = _of("language STRING, term STRING, df BIGINT")
TFIDF = _of("product STRING, language STRING, attribute STRING, term STRING, tfidf DOUBLE")
RUN_LOG = _of("type STRING, timestamp TIMESTAMP, status STRING, cutoff TIMESTAMP, elapsed_sec DOUBLE, latest STRING")
RECOMMENDATIONS = _of("user STRING, rank INT, product STRING, score ARRAY<DOUBLE>, tags ARRAY<STRING>")
#: CSV files of the merge job, without a header.
CSV_NUMERATORS = _of("entity STRING, template STRING, nc BIGINT, na BIGINT")
CSV_DENOMINATORS = _of("entity STRING, template STRING, denominator BIGINT")
CSV_STRENGTHS = _of("entity STRING, template STRING, strength DOUBLE")
