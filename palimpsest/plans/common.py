"""Pieces that several plans and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import temporal as Time
from palimpsest.session import table

AS_OF = 1705276800.0  # 2024-01-15T00:00:00Z
QUERY = "where is the ingeser erat thath in the ndedble"  # three of its words occur in documents

FACTS_SQL = """
facts AS (
  SELECT *, lead(ts_s) OVER w AS invalid_at, lag(event_id) OVER w AS supersedes,
         lag(value) OVER w AS previous_value
  FROM (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0 AS ts_s,
               lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS pv,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
        FROM events)
  WHERE rn = 1 OR value IS DISTINCT FROM pv
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts_s, event_id))
"""


def stem_sql(x: str) -> str:
    return f"CASE WHEN length({x}) > 4 AND ends_with({x}, 'ies') THEN left({x}, -3) || 'y' WHEN length({x}) > 3 AND ends_with({x}, 's') THEN left({x}, -1) ELSE {x} END"


def stems_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda s: {stem_sql('s')})"


def event_facts(spark, sf_dir: str) -> DataFrame:
    """events as facts: one slot per user and event type, with what the generic operators expect."""
    f = Time.facts_from_events(table(spark, sf_dir, "events"))
    return f.select(
        F.col("event_id").alias("seq"), F.col("event_id").alias("fact_id"), F.col("user_id").cast("string").alias("user_id"),
        F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), F.col("value").cast("string").alias("object"),
        "value", "valid_at", F.col("valid_at").alias("created_at"), "invalid_at", "expired_at", "supersedes", F.lit("extracted").alias("source"),
        F.lit(1.0).alias("salience"), F.lit(0).alias("access_count"),
    )


def values_sql(columns: list[str], rows: list[tuple]) -> str:
    """A SELECT of constant rows; the oracle of a fixture."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, int | float):
            return f"CAST({x!r} AS {'BIGINT' if isinstance(x, int) else 'DOUBLE'})"
        return "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(columns)})"
