"""Views of a user: profile fields, structured profile, persona."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as T


def profile(facts: DataFrame, subject: str) -> DataFrame:
    """(predicate, object): the best value per profile key: user-made, then latest, then first."""
    own = facts.where((F.lower("subject") == subject.lower()) & (F.col("predicate").isin(*V.PROFILE_KEYS) | F.startswith("predicate", F.lit("favorite_"))))
    best = F.max_by("object", F.struct(F.col("source").eqNullSafe("user"), F.col("valid_at"), -F.col("seq")))
    return own.groupBy("predicate").agg(best.alias("object"))


def _field(predicate: Column, i: int) -> Column:
    m = F.create_map(*[x for p, v in V.BASIC_FIELDS.items() for x in (F.lit(p), F.lit(v[i]))])
    return F.element_at(m, F.lower(predicate))


def mentions(provenance: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(provenance)), F.lit(0))


def structured_profile(facts: DataFrame, subject: str, user: str) -> DataFrame:
    """(kind, field, item, polarity, grouping, fact_id): basic fields with their best value, preferences
    by group, tentative ones, and habits, of the facts about the user."""
    who = sorted({subject.lower(), user.lower(), *V.SELF_WORDS})
    mine = facts.where(F.lower("subject").isin(*who)).withColumn("_f", _field(F.col("predicate"), 0)).withColumn("_p", T.profile_polarity(F.col("predicate")))
    rank = F.struct(F.col("source").eqNullSafe("user"), mentions(F.col("provenance")), F.col("valid_at"), -F.col("seq"))
    basic = mine.where("_f IS NOT NULL").groupBy(F.col("_f").alias("field")).agg(F.max_by(F.struct("object", "fact_id"), rank).alias("b"))
    basic = basic.select(F.lit("basic").alias("kind"), "field", F.col("b.object").alias("item"), F.lit(None).cast("string").alias("polarity"), F.lit(None).cast("string").alias("grouping"), "b.fact_id")
    rest = mine.where("_f IS NULL")
    pref = rest.where("_p IS NOT NULL").select(
        F.lit("preference").alias("kind"), F.col("predicate").alias("field"), F.col("object").alias("item"), F.col("_p").alias("polarity"), T.preference_group(F.col("predicate"), F.col("object")).alias("grouping"), "fact_id"
    )
    habits = rest.where(F.col("_p").isNull() & T.habit(F.col("predicate"))).select(
        F.lit("habit").alias("kind"), F.col("predicate").alias("field"), F.col("object").alias("item"), F.lit(None).cast("string").alias("polarity"), F.lit(None).cast("string").alias("grouping"), "fact_id"
    )
    return basic.unionByName(pref).unionByName(habits)


def evidence(facts: DataFrame) -> DataFrame:
    """How well a fact is supported: user, reinforced or mentions, and a count."""
    n = F.greatest(F.lit(1), mentions(F.col("provenance")))
    again = (F.col("access_count") > 0) & (n < 2)
    kind = F.when(F.col("source") == "user", "user").when(again, "reinforced").otherwise("mentions")
    count = F.when(F.col("source") == "user", F.lit(1)).when(again, F.col("access_count")).otherwise(n)
    return facts.withColumns({"evidence_kind": kind, "evidence_count": count})


def persona(facts: DataFrame, most: int = 12) -> DataFrame:
    """(user_id, persona): the texts of a user's facts, user-made first, then by salience, ``most`` of them."""
    w = W.partitionBy("user_id").orderBy(F.col("source") != "user", F.desc("salience"), "seq")
    top = facts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    rows = F.array_sort(F.collect_list(F.struct("_rn", "text")))
    return top.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("persona"))
