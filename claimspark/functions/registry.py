"""SQL names for text functions (UD1): temporary functions written in SQL, so that they stay in the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import ACCENTED_LOWER, PLAIN_LOWER


def register(spark: SparkSession) -> list[str]:
    """Registers ascii_fold, norm_key, skeleton, token_set, token_jaccard and parse_vnd for SQL; returns the names."""
    fold = f"regexp_replace(translate(lower(s), '{ACCENTED_LOWER}', '{PLAIN_LOWER}'), '[\\\\u0300-\\\\u036f]', '')"
    made = {
        "ascii_fold(s STRING) RETURNS STRING": fold,
        "norm_key(s STRING) RETURNS STRING": "trim(regexp_replace(ascii_fold(s), '[^a-z0-9]+', ' '))",
        "skeleton(s STRING) RETURNS STRING": "regexp_replace(ascii_fold(s), '[^a-z0-9]+', '')",
        "token_set(s STRING) RETURNS ARRAY<STRING>": "filter(array_distinct(split(norm_key(s), ' ')), t -> length(t) >= 2)",
        "token_jaccard(a STRING, b STRING) RETURNS DOUBLE": "coalesce(try_divide(size(array_intersect(token_set(a), token_set(b))), size(array_union(token_set(a), token_set(b)))), 0D)",
        "parse_vnd(s STRING) RETURNS BIGINT": "try_cast(regexp_replace(s, '[^0-9]', '') AS BIGINT)",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]
