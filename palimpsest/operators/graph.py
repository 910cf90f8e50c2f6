"""The entity graph that facts project to: neighbours, proximity, chains, exclusions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as T
from palimpsest.session import drop_written, written

HOP_DECAY = 0.65


def entities(facts: DataFrame) -> DataFrame:
    """(user_id, key, name): one per lower-case name; the spelling of the first mention stays."""
    kept = facts.where(~F.lower("predicate").isin(*V.TEXT_PREDICATES))
    ends = kept.select("user_id", F.col("subject").alias("name"), (F.col("seq") * 2).alias("o")).unionByName(
        kept.select("user_id", F.col("object").alias("name"), (F.col("seq") * 2 + 1).alias("o"))
    )
    return ends.groupBy("user_id", F.lower("name").alias("key")).agg(F.min_by("name", "o").alias("name"))


def edges(facts: DataFrame) -> DataFrame:
    """(user_id, src, predicate, dst, fact_id, valid_at, invalid_at) by lower-case names; predicates that hold text make none."""
    kept = facts.where(~F.lower("predicate").isin(*V.TEXT_PREDICATES))
    return kept.select("user_id", F.lower("subject").alias("src"), "predicate", F.lower("object").alias("dst"), "fact_id", "valid_at", "invalid_at")


def edge_live(t: float | None) -> Column:
    """Valid time only; every edge if no time is given."""
    if t is None:
        return F.lit(True)
    return (F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def neighbours(e: DataFrame, node: str, direction: str = "out", t: float | None = None) -> DataFrame:
    return e.where((F.col("src" if direction == "out" else "dst") == node) & edge_live(t))


def proximity(e: DataFrame, anchors: DataFrame, hops: int = 2, decay: float = HOP_DECAY, reinforce: bool = True, excluded: DataFrame | None = None) -> DataFrame:
    """(node, score): anchors have 1; each hop passes on ``decay`` of the score. Paths add up to
    at most 1 (or, without ``reinforce``, the best counts). Anchors are never re-entered.

    A hop is a join and an aggregation on the edge's end; the loop is over the few hops.
    """
    ways = both_ways(e)
    if excluded is not None:
        out = excluded.select(F.col("node").alias("x"))
        ways = ways.join(out, ways.src == out.x, "left_anti").join(out, ways.dst == out.x, "left_anti")
    start = anchors.select("node").distinct()
    if excluded is not None:
        start = start.join(excluded.select("node"), "node", "left_anti")
    ways = ways.join(start.select(F.col("node").alias("a")), ways.dst == F.col("a"), "left_anti")
    frontier = start.withColumn("score", F.lit(1.0))
    total = F.sum if reinforce else F.max
    levels = [frontier]
    for _ in range(hops):
        step = frontier.join(ways, frontier.node == ways.src).groupBy(F.col("dst").alias("node")).agg(total(F.col("score") * decay).alias("score"))
        frontier = step.withColumn("score", F.least(F.lit(1.0), F.col("score")))
        levels.append(step)
    every = reduce(DataFrame.unionByName, levels)
    return every.groupBy("node").agg(F.least(F.lit(1.0), F.round(total("score"), 12)).alias("score"))


def relation_relevance(query: str, predicate: Column, subject: Column, obj: Column, text: Column) -> Column:
    """1 if the query has a word for the relation, 0.75 if one of the fact's text, else 0."""
    q = T.words(*sorted(set(T.py_stems(query))))
    alias = F.create_map(*[x for p, ws in V.RELATION_WORDS.items() for x in (F.lit(p), T.words(*sorted({s for w in ws for s in T.py_stems(w)})))])
    terms = F.array_union(T.stems(F.replace(predicate, F.lit("_"), F.lit(" "))), F.coalesce(F.element_at(alias, F.lower(predicate)), T.words()))
    return (
        F.when(F.arrays_overlap(q, terms), F.lit(1.0)).when(F.arrays_overlap(q, T.stems(F.concat_ws(" ", subject, obj, text))), F.lit(0.75)).otherwise(F.lit(0.0))
    )


def has_relation_cue(query: str) -> bool:
    cues = {s for ws in V.RELATION_WORDS.values() for w in ws for s in T.py_stems(w)} | {"where", "who", "whose", "which"}
    return bool(set(T.py_stems(query)) & cues)


def mentioned_entities(ents: DataFrame, query: str, user: str) -> DataFrame:
    """Entities that the query names in full, by a term no other entity has, or as the first person."""
    own = ents.where(F.col("user_id") == user).withColumn("s", T.stems(F.col("name")))
    q = T.words(*sorted(set(T.py_stems(query)) | set(re.findall("[a-z0-9]+", query.lower()))))
    full = own.where((F.size("s") > 0) & (F.size(F.array_except("s", q)) == 0)).select("key")
    usable = lambda t: (F.length(t) >= 3) & ~F.rlike(t, F.lit("^[0-9]+$")) & ~t.isin(*V.ANCHOR_STOP)
    terms = own.select("key", F.explode(F.array_distinct(F.filter("s", usable))).alias("term"))
    alone = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where((F.col("n") == 1) & F.array_contains(q, F.col("term")))
    found = full.unionByName(alone.select("key"))
    if re.search(V.SELF_ANCHOR, query, re.I):
        found = found.unionByName(own.where(F.col("key").isin(user.lower(), "user")).select("key"))
    return found.select(F.col("key").alias("node")).distinct()


def excluded_mentions(ents: DataFrame, query: str, user: str) -> DataFrame:
    """Entities that the query rules out: a name, or a term of its own, within 72 characters after a negation."""
    own = ents.where(F.col("user_id") == user)
    q = F.lit(query.lower())
    usable = lambda t: (F.length(t) >= 3) & ~F.rlike(t, F.lit("^[0-9]+$")) & ~t.isin(*V.ANCHOR_STOP)
    terms = own.select("key", F.explode(F.array_distinct(F.filter(T.stems(F.col("name")), usable))).alias("name"))
    alone = terms.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1").select("key", "name")
    names = own.select("key", F.lower("name").alias("name")).where((F.trim("name") != "") & (F.length("name") <= 96) & (F.size(T.tokens(F.col("name"))) <= 12))
    both = names.unionByName(alone)
    quoted = F.regexp_replace(F.col("name"), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    cue = V.EXCLUSION_CUE[: -len(r"\s*$")]
    shape = F.concat(F.lit(f"(?i){cue}\\s*(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))
    return both.where(F.contains(q, F.col("name")) & F.rlike(q, shape)).select(F.col("key").alias("node")).distinct()


def exclusion_zone(e: DataFrame, direct: DataFrame, t: float | None = None) -> DataFrame:
    """Ruled-out entities, and the subjects whose value they are."""
    value = e.where(F.lower("predicate").isin(*V.VALUE_PREDICATES) & edge_live(t))
    held = value.join(direct.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    return direct.unionByName(held).distinct()


def planned_predicates(query: str) -> list[str]:
    """Predicates in the order the query names them; relations before the attribute asked for."""
    toks = T.py_stems(query)
    hits = []
    for ws, pred in V.CHAIN_WORDS:
        at = [toks.index(T.py_stems(w)[0]) for w in ws if T.py_stems(w) and len(T.py_stems(w)) == 1 and T.py_stems(w)[0] in toks]
        if at:
            hits.append((min(at), pred))
    order = list(dict.fromkeys(p for _, p in sorted(hits)))
    rels, attrs = [p for p in order if p in V.CHAIN_RELATIONS], [p for p in order if p in V.CHAIN_ANSWERS]
    return rels + [p for p in attrs if p not in rels] if rels and attrs else order


def matches_predicate(planned: str, predicate: Column) -> Column:
    same = predicate == planned
    if planned == "works_at":
        same = same | F.startswith(predicate, F.lit("work"))
    if planned == "works_on":
        same = same | predicate.isin(*V.CHAIN_PROJECTS)
    if planned == "based_in":
        same = same | predicate.isin(*V.CHAIN_PLACES)
    if planned == "spouse":
        same = same | predicate.isin("wife", "husband", "partner")
    return same


def place_in_query(query: str) -> str:
    m = re.search(r"\b(?:moved|relocated|lives?|living)\s+(?:to|in)\s+([a-z][a-z' -]{1,40})", query.lower())
    return re.split(r"\b(?:for|with|after|before|who|that|and|or)\b|[?.!,;:]", m[1], maxsplit=1)[0].strip() if m else ""


def walk_chain(e: DataFrame, anchor: str, predicates: list[str], t: float | None = None, place: str = "") -> DataFrame:
    """(node, path): what a chain of predicates leads to from the anchor, one join a hop.

    ``path`` holds the fact ids. Where an attribute is asked for and the query names a
    place, only entities that live there go on. Of several ways to a node the last stays.
    """
    live = e.where(edge_live(t))
    at = live.sparkSession.createDataFrame([(anchor, [])], "node string, path array<string>")
    for p in predicates:
        if p in V.CHAIN_ANSWERS and place and len(predicates) > 1:
            target = T.words(*sorted(set(T.py_stems(place))))
            home = live.where((F.col("predicate") == "lives_in") & (F.size(F.array_except(target, T.stems(F.col("dst")))) == 0))
            home = home.groupBy("src").agg(F.min_by("fact_id", "valid_at").alias("f"))
            at = at.join(home, at.node == home.src).select("node", F.array_append("path", F.col("f").cast("string")).alias("path"))
        step = live.where(matches_predicate(p, F.col("predicate")))
        hop = at.join(step, at.node == step.src).select(F.col("dst").alias("node"), F.array_append("path", F.col("fact_id").cast("string")).alias("path"), F.col("fact_id").alias("f"))
        at = hop.groupBy("node").agg(F.max_by("path", "f").alias("path"))
    return at


def bounded_paths(e: DataFrame, anchors: DataFrame, depth: int = 2, limit: int = 12) -> DataFrame:
    """Edges found from the anchors, nearest first, each once; one layer deeper than proximity."""
    seen = anchors.select("node").distinct().withColumn("d", F.lit(0))
    ways = e.select("src", "dst", "fact_id").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "fact_id"))
    found, frontier = [], seen
    for d in range(depth + 1):
        hop = frontier.join(ways, frontier.node == ways.src).select(F.col("dst").alias("node"), "fact_id").distinct()
        found.append(hop.select("fact_id").withColumn("depth", F.lit(d)))
        frontier = hop.select("node").distinct().join(seen.select("node"), "node", "left_anti").withColumn("d", F.lit(d + 1))
        seen = seen.unionByName(frontier)
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("fact_id").agg(F.min("depth").alias("depth")).orderBy("depth", "fact_id").limit(limit)


def export_graph(facts: DataFrame, t: float, live_only: bool = False) -> DataFrame:
    """Edges with names and a live flag; a dead edge that repeats a live one is hidden."""
    live = (F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t)) & (F.col("expired_at").isNull() | (F.col("expired_at") > t))
    e = facts.where(~F.lower("predicate").isin(*V.TEXT_PREDICATES)).withColumn("live", live)
    w = W.partitionBy("user_id", F.lower("subject"), "predicate", F.lower("object"))
    e = e.withColumn("_some", F.max(F.col("live").cast("int")).over(w)).where(F.col("live") | (F.col("_some") == 0))
    return e.where("live").drop("_some") if live_only else e.drop("_some")


def identity_roots(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(handle, canonical): linked handles share their smallest one, by alternating large-star and small-star steps:
    the larger neighbours of a handle are linked to its smallest one, then a handle and its smaller neighbours are.
    Links never grow in number, and a chain settles in about log n rounds, in whatever order its handles are named."""
    a, b = (F.col(c) for c in links.columns[:2])
    ends = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a IS NOT NULL").distinct()
    given = written(ends)
    e, old = written(given.where("a <> b")), None
    for _ in range(rounds):
        mark = _links_mark(e)
        if mark == old:
            break
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e, old = e, written(small.union(low.toDF("a", "b")).distinct()), mark
        drop_written(last, large)
    else:
        raise RuntimeError(f"identities did not settle in {rounds} rounds")
    every = given.select("a").union(given.select("b")).distinct()
    return every.join(e.withColumnRenamed("b", "m"), "a", "left").select(F.col("a").alias("handle"), F.coalesce("m", "a").alias("canonical"))


def _links_mark(e: DataFrame) -> tuple:
    """What tells whether the links are still the same."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def canonical(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """``facts`` under the canonical handle of their user; roots(handle, canonical) as identity_roots gives them."""
    named = roots.select(F.col("handle").alias("user_id"), "canonical")
    return facts.join(named, "user_id", "left").withColumn("user_id", F.coalesce("canonical", "user_id")).select(*facts.columns)


def touching(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Facts whose subject or object is one of nodes(node)."""
    keys = nodes.select("node").distinct().withColumn("_t", F.lit(True))
    both = facts.join(keys.toDF("_s", "_ts"), F.lower("subject") == F.col("_s"), "left").join(keys.toDF("_o", "_to"), F.lower("object") == F.col("_o"), "left")
    return both.where("_ts OR _to").select(*facts.columns)


def invalidate_edges(e: DataFrame, gone: DataFrame, t: float) -> DataFrame:
    """Edges with those of gone(fact_id) closed at t, unless they were before."""
    hit = gone.select("fact_id").distinct().withColumn("_g", F.lit(True))
    return e.join(hit, "fact_id", "left").withColumn("invalid_at", F.when(F.col("_g"), F.coalesce("invalid_at", F.lit(t))).otherwise(F.col("invalid_at"))).select(*e.columns)


def prune(ents: DataFrame, e: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without the edges of gone(fact_id), and without the entities that nothing touches then."""
    rest = e.join(gone.select("fact_id").distinct(), "fact_id", "left_anti").select(*e.columns)
    ends = rest.select("user_id", F.col("src").alias("key")).union(rest.select("user_id", "dst")).distinct()
    return ents.join(ends, ["user_id", "key"], "left_semi").select(*ents.columns), rest
