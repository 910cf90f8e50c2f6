"""Walks over given supersession links, for many questions at once.

A fact names at most one fact that it supersedes, and may itself be superseded by several:
links make trees, and by mistake circles. A walk takes a seed, all that it goes back to, and
all that came to replace it, whatever their slots. Steps are doubled: a table of links holds
where 1, 2, 4, .. steps lead, so that a chain of n facts takes log n rounds, and what a seed
has reached doubles with every one of them, backwards and forwards alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.session import written


def given_links(facts: DataFrame) -> DataFrame:
    """(x, y): fact x of a user supersedes y, a fact of the same user; other links lead nowhere."""
    old = facts.select(F.col("user_id"), F.col("fact_id").alias("y"))
    new = facts.where("supersedes IS NOT NULL").select("user_id", F.col("fact_id").alias("x"), F.col("supersedes").alias("y"))
    return new.join(old, ["user_id", "y"]).select("x", "y").distinct()


def _twice(jump: DataFrame) -> DataFrame:
    """Where twice as many steps lead."""
    return written(jump.join(jump.toDF("y", "z"), "y").select("x", F.col("z").alias("y")))


def on_circles(links: DataFrame) -> DataFrame:
    """(x) of the facts on circles: those that are still reached after any number of steps. What more and more steps
    reach only shrinks, and has settled once doubling takes nothing away."""
    jump, n = written(links), None
    while True:
        reached = jump.select(F.col("y").alias("x")).distinct()
        now = reached.count()
        if now == n or not now:
            return reached
        jump, n = _twice(jump), now


def _reach(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, node): the seeds and all that links(x, y) lead to from them, each round twice as far."""
    held, jump = written(seeds.distinct()), written(links)
    n = held.count()
    while True:
        far = held.join(jump.toDF("node", "y"), "node").select("qid", F.col("y").alias("node"))
        held = written(held.unionByName(far).distinct())
        now = held.count()
        if now == n:
            return held
        jump, n = _twice(jump), now


def chain_members(facts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, node): for seeds(qid, fact_id) each seed, what it leads back to, and what leads back to it.

    Circles end a walk: backwards it goes once around, forwards it does not enter them. Seeds that are no facts
    have no walk.
    """
    links = written(given_links(facts))
    start = seeds.join(facts.select("fact_id").distinct(), "fact_id").select("qid", F.col("fact_id").alias("node"))
    start = written(start.distinct())
    forward = links.join(on_circles(links), "x", "left_anti").select(F.col("y").alias("x"), F.col("x").alias("y"))
    # a fact has one forerunner at each distance, so a table of steps has at most a row a fact in either direction
    return _reach(start, links).unionByName(_reach(start, forward)).distinct()


def chain_walk(facts: DataFrame, seeds: DataFrame, t: float, limit: int = 12, redact: bool = False) -> DataFrame:
    """``facts`` on the chains of seeds(qid, fact_id) with their qid: those valid by ``t``, ordered by subject,
    predicate and time with a place from 1, at most ``limit`` a question. A chain of which one fact can be seen explains
    nothing and gives no rows. With ``redact`` sensitive facts are no part of any chain."""
    facts = facts.where(~F.coalesce("sensitive", F.lit(False))) if redact else facts
    members = chain_members(facts, seeds).toDF("qid", "fact_id")
    seen = facts.where(F.col("valid_at") <= t).join(members, "fact_id")
    order = [F.lower("subject"), F.lower("predicate"), "valid_at", "fact_id"]
    ranked = seen.withColumns(
        {"place": F.row_number().over(W.partitionBy("qid").orderBy(*order)), "_n": F.count(F.lit(1)).over(W.partitionBy("qid"))}
    )
    return ranked.where((F.col("_n") > 1) & (F.col("place") <= limit)).drop("_n")
