"""Store health and statistics: audit findings, counts, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as T


def slot_overflow(facts: DataFrame, least: int = 3) -> DataFrame:
    """Single-valued identity slots with ``least`` or more live values that no user made."""
    fields = [p for p, (f, _) in V.BASIC_FIELDS.items() if f not in V.SEVERAL_AT_ONCE]
    rows = facts.where((F.col("source") != "user") & F.lower("predicate").isin(*fields))
    return rows.groupBy("user_id", "subject", "predicate").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def audit(facts: DataFrame) -> DataFrame:
    """(fact_id, kind): the first rule that a live fact breaks; outcomes and overflowed slots are passed over."""
    over = slot_overflow(facts).select("user_id", "subject", "predicate")
    rows = facts.where(~F.lower("predicate").isin(*V.OUTCOME_KINDS))
    rows = rows.join(over, ["user_id", "subject", "predicate"], "left_anti").unionByName(
        rows.where(F.col("source") == "user").join(over, ["user_id", "subject", "predicate"], "left_semi")
    )
    obj, pred = F.trim("object"), F.trim("predicate")
    spaced = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    token = F.contains(obj, F.lit("_")) & ~F.contains(obj, F.lit(" ")) & (F.length(obj) > 12)
    clipped = F.rlike(obj, F.lit(r"[)\"'`\]]\s*$|^[(\"'`\[]")) | F.contains(obj, F.lit("`"))
    code = F.rlike(obj, F.lit(r"[/\\]|\.(py|ts|md|json|yaml|sh)\b"))
    shout = (F.size(F.split(obj, r"\s+")) <= 2) & (F.upper(obj) == obj) & (F.lower(obj) != obj)
    vague = F.lower("subject").isin("this", "that", "it", "these", "those", "there", "here")
    kind = (
        F.when(token, "machine_token").when(spaced(obj) == spaced(pred), "empty_value").when(F.length(obj) > 120, "unreduced_claim")
        .when(clipped, "fragment").when(code, "code_artifact").when(shout, "empty_value").when(vague, "dangling_subject")
    )
    return rows.select("user_id", "fact_id", kind.alias("kind")).where("kind IS NOT NULL")


def stats(facts: DataFrame, t: float) -> DataFrame:
    """Counts and times per user, in one pass."""
    live = (F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t)) & (F.col("expired_at").isNull() | (F.col("expired_at") > t))
    return facts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("facts"),
        F.count_if(live).alias("facts_live"),
        F.count_if(~live).alias("facts_superseded"),
        F.count_if("sensitive").alias("facts_sensitive"),
        F.min("valid_at").alias("oldest_valid_at"),
        F.max("valid_at").alias("newest_valid_at"),
    )


def sessions(episodes: DataFrame) -> DataFrame:
    """Turns, pending, summaries and times per session."""
    return episodes.groupBy("user_id", "session_id").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if(~F.col("consolidated")).alias("pending"),
        F.count_if(F.coalesce("summary", F.lit("")) != "").alias("summaries"),
        F.min("event_time").alias("first_at"),
        F.max("event_time").alias("last_at"),
    )


def session_facts(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that came out of each session, by their provenance."""
    said = facts.select("fact_id", F.explode("provenance").alias("episode_id"))
    return said.join(episodes.select("episode_id", "session_id"), "episode_id").groupBy("session_id").agg(F.countDistinct("fact_id").alias("facts"))


def embedder_blindness(texts: DataFrame, text_col: str, share: float = 0.5, least_mass: int = 200, least_share: float = 0.2) -> DataFrame:
    """Whether an ASCII-only embedder cannot see the texts: how many are mostly other letters, and their mass."""
    letters = F.length(F.regexp_replace(F.col(text_col), r"[^\p{L}]", ""))
    other = letters - F.length(F.regexp_replace(F.col(text_col), "[^A-Za-z]", ""))
    blind = (letters > 0) & (other / letters >= share)
    n = texts.select(blind.alias("b"), letters.alias("l"), other.alias("o")).agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("b").alias("blind_texts"), F.sum("l").alias("letters"), F.sum(F.when(F.col("b"), F.col("o")).otherwise(0)).alias("blind_letters")
    )
    return n.withColumn("blind", (F.col("blind_letters") >= least_mass) & (F.col("blind_texts") >= least_share * F.col("texts")))


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no edge touches."""
    ends = edges.select("user_id", F.col("src").alias("key")).unionByName(edges.select("user_id", F.col("dst").alias("key")))
    return entities.join(ends, ["user_id", "key"], "left_anti")


def stale_edges(edges: DataFrame, facts: DataFrame) -> DataFrame:
    return edges.join(facts.select("fact_id"), "fact_id", "left_anti")


def save_guard(manifest: dict, schema_version: int, embedder: str, dim: int) -> None:
    """Refuses a store of a newer schema or of another embedding space."""
    if manifest.get("schema_version", 0) > schema_version:
        raise ValueError(f"the store has schema {manifest['schema_version']}, newer than {schema_version}")
    if manifest.get("embedder_id", embedder) != embedder or manifest.get("embedding_dim", dim) != dim:
        raise ValueError("the store was embedded by another model")


def redacted(facts: DataFrame) -> DataFrame:
    """Sensitive objects and texts masked."""
    mask = lambda c: F.when(F.col("sensitive"), F.lit("[redacted]")).otherwise(F.col(c))
    return facts.withColumns({"object": mask("object"), "text": mask("text")})


def token_estimate(text_col: str):
    return T.tokens_cjk(F.col(text_col))
