"""Retrieval in rounds, and context that a model helps to make. Models are callables; without one, nothing is added."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import graph as G
from palimpsest.operators import models as M
from palimpsest.operators import temporal as Time


def gather(
    pull: Callable[[list[str], int], DataFrame], query: str, decompose: Callable[[str, str], list[str]], k: int, per_query: int = 3, most: int = 4, rounds: int = 2
) -> DataFrame:
    """(id, round, list_no, rank): episodes found for the parts of a question, and, in a second round, for what the
    first ones suggest. ``pull(queries, k)`` gives (list_no, rank, id, text) for all parts in one plan."""
    found, hint = None, ""
    for n in range(rounds):
        parts = decompose(query, hint)[:most] or [query]
        got = pull(parts, per_query).where(F.col("rank") <= per_query).withColumn("round", F.lit(n))
        found = got if found is None else found.unionByName(got)
        heads = found.orderBy("round", "list_no", "rank").limit(5).select(F.left("text", F.lit(200)).alias("t")).collect()  # five lines
        hint = "\n".join(r["t"] for r in heads)
        if not hint:
            break
    first = found.groupBy("id").agg(F.min(F.struct("round", "list_no", "rank")).alias("m"))
    return first.orderBy("m.round", "m.list_no", "m.rank").limit(k).select("id", "m.round", "m.list_no", "m.rank")


def hypothetical(query: str, model: Callable[[str], str] | None) -> str:
    """The question with a passage that might answer it, to search with; alone where the model is silent."""
    said = model(f"Write one short passage that answers: {query}").strip() if model else ""
    return f"{query}\n{said}" if said else query


def grounded_plan(query: str, facts: DataFrame, user: str, t: float, model: Callable[[str], str], most: int = 80) -> tuple[str | None, list[str]]:
    """(anchor, predicates) of a chain as the model plans it, held to what the user's live facts know: other predicates
    are dropped, and a plan of an unknown anchor or fewer than two steps is none."""
    live = facts.where((F.col("user_id") == user) & Time.live_at(t, expired="expired_at"))
    allowed = [r[0] for r in live.groupBy("predicate").agg(F.min("seq").alias("s")).orderBy("s").limit(most).select("predicate").collect()]
    if len(allowed) < 2:
        return None, []
    names = {r["key"]: r["name"] for r in G.entities(live).orderBy("key").limit(most).collect()}
    got = M.salvage(model(f"Question: {query}\nEntities: {sorted(names.values())}\nPredicates: {allowed}\nJSON:"))
    plan = got[0] if got else {}
    known = {p.lower(): p for p in allowed}
    steps = [known[str(p).lower()] for p in plan.get("predicates") or [] if str(p).lower() in known]
    anchor = names.get(str(plan.get("anchor") or "").strip().lower())
    return (anchor, steps) if anchor and len(steps) >= 2 else (None, [])


def bridge_hop(facts: DataFrame, frontier: DataFrame, predicate: str, t: float) -> DataFrame:
    """(node, path): a hop along facts rather than edges: frontier(node, path) joined on their subjects."""
    fits = F.lower("predicate") == predicate.lower()
    live = facts.where(fits & Time.live_at(t, expired="expired_at")).select(F.lower("subject").alias("node"), F.lower("object").alias("_next"), "fact_id")
    out = frontier.join(live, "node").select(F.col("_next").alias("node"), F.array_append("path", F.col("fact_id")).alias("path"))
    return out.groupBy("node").agg(F.min("path").alias("path"))


def walk_facts(facts: DataFrame, anchor: str, predicates: list[str], t: float) -> DataFrame:
    """(node, path) at the end of a chain of predicates, one join a hop."""
    at = facts.sparkSession.createDataFrame([(anchor.lower(), [])], f"node string, path array<{dict(facts.dtypes)['fact_id']}>")
    for p in predicates:
        at = bridge_hop(facts, at, p, t)
    return at


def entity_notes(facts: DataFrame, query: str, user: str, t: float, model: Callable[[str], str], most: int = 3, lines: int = 40) -> DataFrame:
    """(entity, note): what a model makes of the dated facts, past ones marked, of the entities that the query names."""
    own = facts.where(F.col("user_id") == user)
    named = G.mentioned_entities(G.entities(own), query, user).orderBy("node").limit(most)
    mark = F.when(Time.live_at(t, expired="expired_at"), "").otherwise(" (past)")
    line = F.concat(F.lit("["), T.epoch_date(F.col("valid_at")), F.lit("] "), F.col("text"), mark)
    of = own.join(named, F.lower("subject") == F.col("node"))
    from pyspark.sql import Window as W

    last = of.withColumn("_rn", F.row_number().over(W.partitionBy("node").orderBy(F.desc("valid_at"), "seq"))).where(F.col("_rn") <= lines)
    told = last.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("valid_at", "seq", line.alias("l")))).alias("ls"))
    prompt = F.concat(F.lit("Summarize what is known about "), F.col("node"), F.lit(", and what is outdated.\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    answered, _ = M.complete(told.select(F.col("node").alias("entity"), prompt.alias("prompt")), model)
    return answered.where("trim(answer) <> ''").select("entity", F.trim("answer").alias("note"))


def verified(answer: str, context: str, model: Callable[[str], str] | None) -> bool:
    """Whether a model finds an answer supported; true without one."""
    if model is None:
        return True
    said = model(f"Context:\n{context}\n\nAnswer: {answer}\nIs it supported? yes or no").strip().lower()
    return said.startswith("y") or "yes" in said[:5]


def intents(query: str, model: Callable[[str], str] | None, known: tuple[str, ...]) -> list[str]:
    """The blocks that a model asks for, of those known; none where it is silent or unreadable."""
    if model is None:
        return []
    try:
        said = json.loads(model(f"Which of {list(known)} does this need? {query}\nJSON list:"))
    except ValueError:
        return []
    return [x for x in said if x in known] if isinstance(said, list) else []
