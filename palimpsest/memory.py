"""A store of memory behind one object: tables in, tables and answers out.

Every method is a plan over the held tables; a write replaces a table by a new one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as T
from palimpsest.operators import blocks as Blocks
from palimpsest.operators import context as Context
from palimpsest.operators import graph as G
from palimpsest.operators import health as Health
from palimpsest.operators import lifecycle as Life
from palimpsest.operators import models as Models
from palimpsest.operators import profile as Profile
from palimpsest.operators import sessions as Sessions
from palimpsest.operators import temporal as Time
from palimpsest.operators.extract import extract, learn_names
from palimpsest.operators.reconcile import FACT, reconcile
from palimpsest.session import cut_lineage
from palimpsest.sources import conversations as Conv
from palimpsest.sources import files as Files
from palimpsest.sources import store as Store

EPISODE = (
    "episode_id string, user_id string, session_id string, content string, event_time double, ingested_at double, seq long, fingerprint string, "
    "summary string, consolidated boolean, ephemeral boolean, source string"
)


def _fresh() -> dict:
    """What an episode has that nothing has been made of yet."""
    return {"summary": F.lit(None).cast("string"), "consolidated": F.lit(False), "ephemeral": F.lit(False), "source": F.lit("chat")}


VECTORS = {"facts": {"embedding": "text"}, "episodes": {"embedding": "content", "summary_embedding": "summary"}, "working": {"embedding": "content"}, "names": {}}


class Memory:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.episodes = spark.createDataFrame([], EPISODE)
        self.names = spark.createDataFrame([], "user_id string, known_name string")
        self.facts = self._dressed(spark.createDataFrame([], FACT))
        self.working = spark.createDataFrame([], Sessions.WORKING)
        self.version: str | None = None
        self.policy: dict[str, str] = {}
        self.track: list[str] = []
        self.mute: list[str] = []
        self.embedder = None
        self.arrivals = 0

    def _append(self, name: str, new: DataFrame) -> None:
        """Rows of one of the tables, with all columns that it has by now: what is new is hot, and has vectors
        once the memory has been embedded."""
        held = getattr(self, name)
        if "tier" in held.columns and "tier" not in new.columns:
            new = new.withColumn("tier", F.lit("hot"))
        if self.embedder:
            for out, text in VECTORS[name].items():
                new = Models.embed(new.drop(out), self.embedder, text, out)
        known = [c for c in new.columns if c in held.columns]
        setattr(self, name, cut_lineage(held.unionByName(new.select(*known), allowMissingColumns=True)))

    def _arrival(self) -> int:
        """The number of the next arrival: the order of what comes at one time."""
        self.arrivals += 1
        return self.arrivals

    def _dressed(self, facts: DataFrame) -> DataFrame:
        """Facts with text, category and sensitivity filled in."""
        text = T.fact_text(F.col("subject"), F.col("predicate"), F.col("object"))
        base = {"access_count": F.lit(0), "last_access": F.col("valid_at"), "category": F.lit(""), "sensitive": F.lit(False), "text": text}
        return Life.classify(facts.withColumns({k: v for k, v in base.items() if k not in facts.columns}))

    # writing
    @property
    def pending(self) -> DataFrame:
        return self.episodes.where("NOT consolidated")

    def import_messages(self, messages: DataFrame, user: str) -> None:
        """Sessions that are not known yet become pending episodes."""
        new = Conv.import_episodes(messages, user, self.episodes)
        new = new.withColumns({"ingested_at": F.col("event_time"), "seq": F.lit(self._arrival()).cast("long"), **_fresh()})
        self._append("episodes", new)

    def import_files(self, files: DataFrame, user: str, session: str = "imported") -> None:
        """files(id, text) of any known format."""
        self.import_messages(Conv.read_any(files, session), user)

    def import_documents(self, root: str, user: str, caption=None) -> DataFrame:
        """Documents below a folder, a session each; images by their caption. (path, kind, ok) tells which had text."""
        docs = Files.documents(self.spark, root)
        shown = Files.caption(self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content"), caption).select("path", "caption")
        docs = docs.join(shown, "path").withColumn("text", F.when(F.col("kind") == "image", F.concat(F.lit("[image] "), F.col("caption"))).otherwise(F.col("text")))
        docs = cut_lineage(docs.select("path", "kind", "text", (F.coalesce("text", F.lit("")) != "").alias("ok")))
        m = docs.where("ok").select(
            F.element_at(F.split("path", "/"), -1).alias("session_id"), F.lit("").alias("title"), F.lit(0).cast("long").alias("pos"), F.lit("document").alias("speaker"),
            F.col("text").alias("content"), F.lit(None).cast("double").alias("event_time"), F.lit("document").alias("source"),
        )
        self.import_messages(m, user)
        return docs.select("path", "kind", "ok")

    def add(self, content: str, user: str, at: float, session: str = "default", speaker: str = "user") -> None:
        row = [(session, "", int(at), speaker, content, float(at), "records")]
        schema = "session_id string, title string, pos long, speaker string, content string, event_time double, source string"
        made = Conv.import_episodes(self.spark.createDataFrame(row, schema), user)
        seq = F.lit(self._arrival()).cast("long")
        own = F.concat(F.lit("ep_"), F.left(F.sha2(F.concat_ws("\x1f", "fingerprint", seq), 256), F.lit(12)))  # the same words again are another episode
        new = made.withColumns({"content": F.lit(content), "ingested_at": F.lit(float(at)), "seq": seq, "episode_id": own, **_fresh()})
        self._append("episodes", new)

    def remember(self, content: str, user: str, at: float, session: str = "default", scope: str = "auto", ttl: float | None = None) -> str:
        """An episode, and for a passing state a working item instead of durable facts. The scope it went to."""
        seq = self._arrival()
        key = hashlib.sha256("\x1f".join((user, session, content, repr(at), str(seq))).encode()).hexdigest()
        row = self.spark.createDataFrame([(f"ep_{key[:12]}", user, session, content, float(at))], "episode_id string, user_id string, session_id string, content string, event_time double")
        episodes, items = Sessions.remember(row, scope, ttl)
        more = {**_fresh(), "consolidated": F.col("consolidated"), "ephemeral": F.col("ephemeral")}
        new = episodes.withColumns({"ingested_at": F.lit(float(at)), "seq": F.lit(seq).cast("long"), "fingerprint": F.lit(key), **more})
        self._append("episodes", new)
        items = cut_lineage(items)
        self._append("working", items)
        return "long" if items.isEmpty() else "working"

    def working_memory(self, user: str, t: float, session: str | None = None, kind: str | None = None) -> DataFrame:
        return Sessions.working_items(self.working, user, t, session, kind)

    def consume(self, item_id: str) -> None:
        self.working = cut_lineage(Sessions.consume(self.working, self.spark.createDataFrame([(item_id,)], "item_id string")))

    def clear_session(self, user: str, session: str) -> int:
        gone = self.working.where((F.col("user_id") == user) & (F.col("session_id") == session))
        n = gone.count()
        self.working = cut_lineage(Sessions.clear_sessions(self.working, self.spark.createDataFrame([(user, session)], "user_id string, session_id string")))
        return n

    def _fold_in(self, new: DataFrame) -> None:
        """New facts folded with those of the same user and subject; no other fact is touched."""
        base = [c.split()[0] for c in FACT.split(", ")]
        keys = lambda df: df.withColumn("_key", F.lower(F.trim("subject")))
        touched = cut_lineage(keys(new).select("user_id", "_key").distinct())
        known = keys(self.facts)
        rest = known.join(touched, ["user_id", "_key"], "left_anti").select(*self.facts.columns)
        near = cut_lineage(known.join(touched, ["user_id", "_key"], "left_semi").select(*self.facts.columns))
        more = [c for c in self.facts.columns if c not in base]
        folded = reconcile(near.select(*base).unionByName(new.select(*base))).join(near.select("fact_id", *more), "fact_id", "left")
        folded = folded.withColumn("text", F.coalesce("text", T.fact_text(F.col("subject"), F.col("predicate"), F.col("object"))))
        folded = folded.withColumns({"access_count": F.coalesce("access_count", F.lit(0)), "last_access": F.coalesce("last_access", "valid_at")})
        if "tier" in more:
            folded = folded.withColumn("tier", F.coalesce("tier", F.lit("hot")))
        folded = cut_lineage(Life.classify(folded).select(*self.facts.columns))
        if self.embedder:
            fresh = Models.embed(folded.where("embedding IS NULL").drop("embedding"), self.embedder, "text")
            folded = folded.where("embedding IS NOT NULL").unionByName(fresh)
        self.facts = cut_lineage(rest.unionByName(folded))

    def consolidate(self, which=None) -> int:
        """Pending episodes, or those of them that a condition names, into facts. How many there were."""
        todo = cut_lineage(self.pending if which is None else self.pending.where(which))
        self._fold_in(cut_lineage(extract(todo, self.names)))
        self.names = cut_lineage(learn_names(todo, self.names))
        done = todo.select("episode_id").withColumn("_d", F.lit(True))
        marked = self.episodes.join(done, "episode_id", "left").withColumn("consolidated", F.col("consolidated") | F.coalesce("_d", F.lit(False)))
        self.episodes = cut_lineage(marked.select(*self.episodes.columns))
        return todo.count()

    def add_fact(self, subject: str, predicate: str, obj: str, user: str, at: float) -> None:
        key = hashlib.sha256("\x1f".join((user, subject, predicate, obj, repr(at))).encode()).hexdigest()[:12]
        row = [(f"fact_{key}", user, subject, predicate, obj, float(at), float(at), None, None, None, "user", 1.0, [], self._arrival())]
        self._fold_in(self.spark.createDataFrame(row, FACT))

    def close_session(self, user: str, session: str, t: float, summarise: bool = True, clear_working: bool = True, model=None) -> dict:
        """Pending episodes of the session become facts, its episodes get summaries, its working memory goes, and a
        model's conclusions are kept once, however often it is closed. ``model(prompt)`` answers with JSON objects
        of kind, statement and why."""
        own = (F.col("user_id") == user) & (F.col("session_id") == session)
        before = self.facts.count()
        done = self.consolidate(own)
        out = {"episodes": self.episodes.where(own).count(), "pending_consolidated": done, "facts_added": self.facts.count() - before, "summaries": 0, "outcomes": 0, "working_cleared": 0}
        if summarise:
            blank = own & (F.coalesce("summary", F.lit("")) == "")
            out["summaries"] = self.episodes.where(blank).count()
            told = Life.summarise(self.episodes.where(own))
            if self.embedder:
                told = Models.embed(told.drop("summary_embedding"), self.embedder, "summary", "summary_embedding")
            made = told.unionByName(self.episodes.where(~own))
            self.episodes = cut_lineage(made.select(*self.episodes.columns))
        if clear_working:
            out["working_cleared"] = self.clear_session(user, session)
        if model is not None:
            text = self.episodes.where(own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_time", "seq", "content"))), lambda e: e["content"]), "\n").alias("t"))
            ask = text.select(F.concat(F.lit(self.policy.get("outcomes", "What was concluded? JSON list of kind, statement, why.\n")), F.col("t")).alias("prompt"))
            said = [x for r in Models.complete(ask, model)[0].collect() for x in Models.salvage(r["answer"])]
            rows = [(session, str(x.get("kind", "")), str(x.get("statement", "")), str(x.get("why", ""))) for x in said]
            found = Models.outcomes(self.spark.createDataFrame(rows, "session_id string, kind string, statement string, why string"), V.OUTCOME_KINDS)
            new = cut_lineage(Sessions.new_outcomes(found.withColumn("user_id", F.lit(user)), self.facts, t))
            key = F.concat(F.lit("fact_"), F.left(F.sha2(F.concat_ws("\x1f", "user_id", "session_id", "text"), 256), F.lit(12)))
            base = {
                "fact_id": key, "subject": F.col("session_id"), "predicate": F.col("kind"), "object": F.col("text"), "valid_at": F.lit(t), "created_at": F.lit(t), "invalid_at": F.lit(None).cast("double"),
                "expired_at": F.lit(None).cast("double"), "supersedes": F.lit(None).cast("string"), "source": F.lit("extracted"), "salience": F.lit(1.0), "provenance": F.array().cast("array<string>"), "seq": F.lit(int(t)),
            }
            out["outcomes"] = new.count()
            self._append("facts", self._dressed(new.withColumns(base)))
        return out

    def set_policy(self, **prompts: str) -> None:
        """Prompts in place of the usual ones; an empty one goes back to those."""
        self.policy = {k: v for k, v in {**self.policy, **prompts}.items() if v}

    def reembed(self, model) -> dict[str, int]:
        """Vectors of facts, episodes, summaries and working memory anew, from their texts, and from now on of whatever
        is added; entities are found by name."""
        self.embedder = model
        for name, vectors in VECTORS.items():
            df = getattr(self, name).drop(*vectors)
            for out, text in vectors.items():
                df = Models.embed(df, model, text, out)
            setattr(self, name, cut_lineage(df))
        told = self.episodes.where(F.coalesce("summary", F.lit("")) != "")
        return {"facts": self.facts.count(), "episodes": self.episodes.count(), "summaries": told.count(), "working": self.working.count()}

    def evict(self, most_hot: int) -> None:
        self.facts = cut_lineage(Life.evict_cold(self.facts.drop("tier"), most_hot))

    def update_fact(self, fact_id: str, **changes) -> None:
        self.facts = cut_lineage(Life.edit_fact(self.facts, fact_id, **changes))

    def delete_fact(self, fact_id: str) -> None:
        self.facts = Life.delete_facts(self.facts, self.spark.createDataFrame([(fact_id,)], "fact_id string"))

    def forget(self, user: str) -> None:
        """Nothing of the user stays: facts, episodes with their summaries, working memory and the name."""
        for name in VECTORS:
            setattr(self, name, cut_lineage(getattr(self, name).where(~F.col("user_id").eqNullSafe(user))))

    def set_focus(self, track: list[str] | None = None, mute: list[str] | None = None) -> None:
        self.track, self.mute = track or [], mute or []

    def decay(self, t: float) -> None:
        self.facts = Life.decay_sweep(self.facts, t)

    # reading
    def _view(self) -> DataFrame:
        return Life.apply_focus(self.facts, self.track, self.mute)

    def as_of(self, t: float, user: str) -> DataFrame:
        return Time.as_of(self.facts.where(F.col("user_id") == user), t)

    def history(self, user: str, subject: str, predicate: str) -> DataFrame:
        return Time.slot_history(self.facts, user, subject, predicate)

    def search(self, query: str, user: str, t: float, k: int = 5) -> tuple[str, str, list]:
        """Over what is hot; then over what is cold, which a hit warms; then over summaries."""
        facts = self._view()
        tiered = "tier" in facts.columns
        got = Context.search(facts.where("tier <> 'cold'") if tiered else facts, query, user, t, k)
        if got[0] == "abstain" and tiered:
            cold = Context.search(facts.where("tier = 'cold'"), query, user, t, k)
            if cold[0] != "abstain":
                hits = self.spark.createDataFrame([(i,) for i in cold[2]], "fact_id string")
                self.facts = cut_lineage(Sessions.page_in(self.facts, hits))
                return cold
        if got[0] == "abstain":
            told = self.episodes.where((F.col("user_id") == user) & (F.col("event_time") <= t) & (F.coalesce("summary", F.lit("")) != ""))
            best = Blocks.summary_answer(told, query).first()
            if best:
                return "summary", best["summary"], [best["episode_id"]]
        return got

    def recall(self, query: str, user: str, t: float, budget: int = 6000, redact: bool = False, answerer=None) -> dict:
        """A small context for a question and its size. With ``answerer(prompt)`` also an answer over it, and what the
        whole history would have cost."""
        facts = self._view()
        facts = facts.where(~F.coalesce("sensitive", F.lit(False))) if redact else facts
        ctx = Blocks.lean_context(facts, self.episodes, query, user, t, budget)
        out = {"context": ctx, "tokens_est": self._tokens(ctx), "redacted_sensitive": redact}
        if answerer is not None:
            full = Sessions.full_history_tokens(self.episodes.where(F.col("user_id") == user), t).first()
            out |= {"full_tokens": full["full_tokens"] if full else 0, "answer": answerer(f"Memory:\n{ctx}\n\nQuestion: {query}").strip() if ctx.strip() else ""}
        return out

    def recall_spaces(self, query: str, spaces: list[str], t: float, budget: int = 6000, redact: bool = False) -> dict:
        """The contexts of several spaces under their names; no graph walk crosses spaces."""
        found = [(s, self.recall(query, s, t, budget, redact)["context"]) for s in spaces]
        ctx = "\n\n".join(f"## Space: {s}\n{c}" for s, c in found if c.strip())
        return {"context": ctx, "tokens_est": self._tokens(ctx), "spaces": list(spaces), "redacted_sensitive": redact}

    def _tokens(self, text: str) -> int:
        return self.spark.createDataFrame([(text,)], "t string").select(T.tokens_cjk(F.col("t"))).first()[0]

    def status(self, t: float) -> DataFrame:
        return Sessions.agent_status(self.episodes, self.working, t)

    def session_report(self, t: float, sensitive: bool = False) -> DataFrame:
        return Sessions.session_report(self.facts, self.episodes, t, sensitive)

    def lean_context(self, query: str, user: str, t: float, budget: int = 6000) -> str:
        return Blocks.lean_context(self._view(), self.episodes, query, user, t, budget)

    def graph(self, t: float, live_only: bool = False) -> DataFrame:
        return G.export_graph(self.facts, t, live_only)

    def profile(self, subject: str) -> DataFrame:
        return Profile.profile(self.facts.where(F.col("expired_at").isNull()), subject)

    def structured_profile(self, subject: str, user: str) -> DataFrame:
        return Profile.structured_profile(self.facts.where(F.col("expired_at").isNull()), subject, user)

    def persona(self) -> DataFrame:
        return Profile.persona(self.facts.where(F.col("expired_at").isNull()))

    def stats(self, t: float) -> DataFrame:
        return Health.stats(self.facts, t)

    def audit(self, t: float) -> DataFrame:
        return Health.audit(Time.as_of(self.facts, t))

    # keeping
    def save(self, root: str) -> dict:
        """Refused if another writer has saved since this one opened the store."""
        tables = {"facts": self.facts, "episodes": self.episodes, "names": self.names, "working": self.working}
        state = {"track": self.track, "mute": self.mute, "policy": self.policy, "arrivals": self.arrivals}
        made = Store.save(self.spark, root, tables, state=state, expected=self.version)
        self.version = made["version"]
        return made

    def stale(self, root: str) -> bool:
        """Whether someone has saved since."""
        return Store.current_version(self.spark, root) != self.version

    @classmethod
    def open(cls, spark: SparkSession, root: str, embedder=None) -> Memory:
        """What was saved, with every column. Vectors are read back; ``embedder`` makes those of what is added."""
        m = cls(spark)
        for name, df in Store.load(spark, root).items():
            setattr(m, name, getattr(m, name).unionByName(df, allowMissingColumns=True))  # every column that was saved
        state = (Store.read_manifest(spark, root) or {}).get("state", {})
        m.set_focus(state.get("track"), state.get("mute"))
        m.policy = state.get("policy", {})
        m.arrivals = state.get("arrivals", 0)
        m.embedder = embedder
        m.version = Store.current_version(spark, root)
        return m
