"""Readers that turn exports and logs into one shape: a row per message.

Messages: session_id, title, pos, speaker, content, event_time (seconds or null), source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.ordering import spread_rank
from palimpsest.session import written

COLUMNS = ["session_id", "title", "pos", "speaker", "content", "event_time", "source"]

# fixed values: alternative keys, first hit counts
ROLE_KEYS = ("role", "speaker", "author", "from", "sender")
CONTENT_KEYS = ("content", "text", "message", "body", "value")
TIME_KEYS = ("event_time", "timestamp", "time", "created_at", "create_time", "date", "ts")
SESSION_KEYS = ("session_id", "session", "conversation_id", "thread_id", "chat_id")

# fixed values: what an agent log holds beside the conversation
SKIP_BLOCKS = ("thinking", "redacted_thinking", "tool_use", "tool_result", "image")
SKIP_ROWS = ("queue-operation", "ai-title", "custom-title", "last-prompt", "attachment", "summary", "file-history-snapshot", "system")
ECHOES = ("<tool_use_result", "<local-command", "Caveat: The messages below")
SPEAKER = r"^\s*([A-Za-z][\w .'-]{0,30}?)\s*[:：]\s+(.*\S.*)$"

MAP = "map<string,string>"


def _once(rows: DataFrame) -> DataFrame:
    """``rows``, each column computed once. A filter on computed columns is otherwise moved below them and parses the same
    JSON again for each mention of a column."""
    return rows.select(F.inline_outer(F.array(F.struct(*rows.columns))))


def first_key(record: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys with a value that is not empty; ``record`` maps names to raw JSON."""
    return F.coalesce(*[F.when(F.coalesce(record[k], F.lit("")) != "", record[k]) for k in keys])


def content_text(raw: Column) -> Column:
    """Plain text of a content field: a string, {parts}, {text}, or a list of strings and text parts."""
    parts = F.from_json(raw, "array<string>")
    one = F.from_json(raw, MAP)
    kinds = ("text", "input_text", "output_text")

    def part(p: Column) -> Column:
        m = F.from_json(p, MAP)
        ok = m["type"].isNull() | m["type"].isin(*kinds)
        return F.when(F.startswith(p, F.lit("{")), F.when(ok, F.coalesce(m["text"], m["content"], F.lit("")))).otherwise(p)

    def joined(a: Column) -> Column:
        return F.array_join(F.filter(F.transform(a, part), lambda x: x.isNotNull() & (x != "")), "\n")

    nested = F.when(one["parts"].isNotNull(), joined(F.from_json(one["parts"], "array<string>"))).otherwise(F.coalesce(one["text"], one["content"], one["value"], F.lit("")))
    shape = F.substring(F.ltrim(raw), 1, 1)
    return F.when((shape == "[") & parts.isNotNull(), joined(parts)).when((shape == "{") & one.isNotNull(), nested).otherwise(F.coalesce(raw, F.lit("")))


def _speaker(raw: Column, default: str = "user") -> Column:
    return F.coalesce(F.when(F.startswith(raw, F.lit("{")), F.from_json(raw, MAP)["role"]).otherwise(raw), F.lit(default))


def chat_array(files: DataFrame, session_id: str = "imported") -> DataFrame:
    """files(id, json): {role, content} arrays, {messages} wrappers, or lists of such conversations."""
    body = F.coalesce(F.from_json("json", MAP)["messages"], F.col("json"))
    rows = files.select("id", F.posexplode(F.from_json(body, "array<string>")).alias("i", "item"))
    rows = _once(rows.withColumn("inner", F.coalesce(F.from_json("item", MAP)["messages"], F.when(F.startswith("item", F.lit("[")), F.col("item")))))
    many = F.col("inner").isNotNull()
    rows = rows.select("id", "i", many.alias("many"), F.posexplode_outer(F.when(many, F.from_json("inner", "array<string>")).otherwise(F.array("item"))).alias("p", "m"))
    name = F.when(F.col("many"), F.concat(F.lit(session_id + "_"), F.col("i"))).otherwise(session_id)
    return _messages(rows.select("id", name.alias("session_id"), F.when(F.col("many"), F.col("p")).otherwise(F.col("i")).alias("pos"), F.from_json("m", MAP).alias("r")), "messages")


def _messages(rows: DataFrame, source: str) -> DataFrame:
    """Rows with r, a message's fields as raw JSON; those without content are left out, and so are malformed ones."""
    ids = [c for c in ("id",) if c in rows.columns]
    raw = [first_key(F.col("r"), keys).alias(name) for name, keys in (("_role", ROLE_KEYS), ("_content", CONTENT_KEYS), ("_time", TIME_KEYS))]
    r = _once(rows.select(*ids, "session_id", "pos", *raw))
    out = r.select(
        *ids, "session_id", F.lit("").alias("title"), "pos", _speaker(F.col("_role")).alias("speaker"),
        F.trim(content_text(F.col("_content"))).alias("content"), T.to_epoch(F.col("_time")).alias("event_time"),
        F.lit(source).alias("source"),
    )
    return _once(out).where("content <> ''")


def records(lines: DataFrame, session_id: str = "imported") -> DataFrame:
    """lines(seq, json): one record a row, in sessions by their own session key; malformed rows are skipped."""
    ids = [c for c in ("id",) if c in lines.columns]
    r = _once(lines.select(*ids, "seq", F.from_json("json", MAP).alias("r")))
    return _messages(r.select(*ids, F.coalesce(first_key(F.col("r"), SESSION_KEYS), F.lit(session_id)).alias("session_id"), F.col("seq").alias("pos"), "r"), "records")


def _thread(nodes: Column, parents: Column, head: Column) -> Column:
    """Where the nodes from a head up to its root stand; a node that comes again ends the walk."""

    def walk(names, parents, x: str | None) -> list[int]:
        at = {n: i for i, n in enumerate(names)}
        path: dict[int, None] = {}
        while (i := at.get(x)) is not None and i not in path:
            path[i] = None
            x = parents[i]
        return list(path)

    @F.pandas_udf("array<int>")
    def thread(n: pd.Series, p: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([[] if a is None else walk(a, b, c) for a, b, c in zip(n, p, h, strict=True)])

    return thread(nodes, parents, head)


def chat_export(conversations: DataFrame) -> DataFrame:
    """conversations(i, json) of message trees: the path from the current node up to the root, oldest
    first; every message by time where there is none. Hidden, system and blank messages go.

    A conversation is one row, and so are its walk and its messages in order, however long.
    """
    conv = _once(conversations.select("i", F.from_json("json", MAP).alias("c")))
    tree = conv.select(
        "i", F.coalesce(F.col("c.conversation_id"), F.col("c.id"), F.concat(F.lit("chatgpt_"), F.col("i"))).alias("session_id"),
        F.coalesce(F.col("c.title"), F.concat(F.lit("conversation "), F.col("i") + 1)).alias("title"), F.from_json("c.mapping", MAP).alias("t"), F.col("c.current_node").alias("head"),
    )
    tree = _once(tree.select("i", "session_id", "title", F.map_keys("t").alias("names"), F.transform(F.map_values("t"), lambda b: F.from_json(b, "parent string, message string")).alias("nodes"), "head"))
    tree = tree.withColumn("path", _thread(F.col("names"), F.col("nodes.parent"), F.col("head"))).drop("names")
    chosen = F.transform(F.reverse("path"), lambda j: F.get(F.col("nodes"), j)["message"])
    time = lambda n: F.coalesce(F.from_json(n["message"], MAP)["create_time"].try_cast("double"), F.lit(0.0))
    loose = F.transform(F.array_sort(F.transform("nodes", lambda n, j: F.struct(time(n).alias("o"), j.alias("j"), n["message"].alias("m")))), lambda x: x["m"])
    told = tree.select("i", "session_id", "title", F.when(F.size("path") > 0, chosen).otherwise(loose).alias("ms"))
    msg = told.select("i", "session_id", "title", F.posexplode_outer("ms").alias("o", "m")).select("i", "session_id", "title", "o", F.from_json("m", MAP).alias("m"))
    role = F.coalesce(F.from_json("m.author", MAP)["role"], F.lit("user"))
    hidden = F.coalesce(F.from_json("m.metadata", MAP)["is_visually_hidden_from_conversation"] == "true", F.lit(False))
    msg = _once(msg.withColumn("role", role).withColumn("hidden", hidden)).where(F.col("m").isNotNull() & ~F.col("hidden") & (F.col("role") != "system"))
    out = msg.select(
        "session_id", "title", (F.row_number().over(W.partitionBy("i").orderBy("o")) - 1).alias("pos"), F.col("role").alias("speaker"),
        F.trim(content_text(F.col("m.content"))).alias("content"), T.to_epoch(F.col("m.create_time")).alias("event_time"), F.lit("chatgpt").alias("source"),
    )
    return _once(out).where("content <> ''")


def transcript(lines: DataFrame, session_id: str = "imported") -> DataFrame:
    """lines(id, line_no, line): 'Speaker: text' opens a turn and other lines go on with it; a text
    without speakers is one message of the user."""
    said = F.regexp_extract("line", SPEAKER, 1)
    w = W.partitionBy("id").orderBy("line_no")
    rows = lines.where(F.trim("line") != "").withColumn("opens", (said != "").cast("int")).withColumn("turn", F.sum("opens").over(w)).withColumn("any", F.max("opens").over(W.partitionBy("id")))
    body = F.trim(F.when(F.col("opens") == 1, F.regexp_extract("line", SPEAKER, 2)).otherwise(F.col("line")))
    g = rows.groupBy("id", "turn", "any").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("t")))), lambda x: x["t"]), "\n").alias("content"), F.max(F.trim(said)).alias("who")
    )
    speaker = F.when(F.col("who") == "", "user").otherwise(F.col("who"))
    return g.select(
        "id", F.lit(session_id).alias("session_id"), F.lit("").alias("title"), F.col("turn").alias("pos"), speaker.alias("speaker"), "content",
        F.lit(None).cast("double").alias("event_time"), F.lit("transcript").alias("source"),
    )


def agent_log(lines: DataFrame, sidechains: bool = False, min_chars: int = 12) -> DataFrame:
    """lines(session_id, line_no, line) of an agent's session log: what user and assistant said, secrets masked."""
    r = _once(lines.where(F.startswith(F.trim("line"), F.lit("{"))).select("session_id", "line_no", F.from_json("line", MAP).alias("r"))).where("r IS NOT NULL")
    r = r.where(~F.coalesce(F.col("r.type").isin(*SKIP_ROWS), F.lit(False)))
    if not sidechains:
        r = r.where(F.coalesce(F.col("r.isSidechain"), F.lit("false")) != "true")
    r = r.select("session_id", "line_no", "r", F.from_json("r.payload", MAP).alias("pay"))
    m = F.coalesce(F.from_json("r.message", MAP), F.when(F.col("pay.type") == "message", F.col("pay")))
    r = _once(r.select("session_id", "line_no", F.col("r.type").alias("type"), F.col("r.timestamp").alias("time"), m.alias("m")))
    r = r.where("m IS NOT NULL").withColumn("role", F.coalesce(F.col("m.role"), F.col("type"))).where(F.col("role").isin("user", "assistant"))
    blocks = F.from_json("m.content", f"array<{MAP}>")
    kept = F.filter(blocks, lambda b: ~F.coalesce(b["type"].isin(*SKIP_BLOCKS), F.lit(False)))
    texts = F.transform(kept, lambda b: F.trim(F.coalesce(b["text"], b["content"], F.lit(""))))
    body = F.when(F.startswith(F.ltrim("m.content"), F.lit("[")), F.array_join(F.filter(texts, lambda t: t != ""), "\n")).otherwise(F.trim("m.content"))
    r = _once(r.select("session_id", "line_no", "role", "time", body.alias("content"))).where((F.length("content") >= min_chars) & ~T.starts_with_any(F.col("content"), ECHOES))
    return r.select(
        "session_id", F.lit("").alias("title"), F.col("line_no").alias("pos"), F.col("role").alias("speaker"), T.redact_secrets(F.col("content")).alias("content"),
        T.to_epoch(F.col("time")).alias("event_time"), F.lit("agent_session").alias("source"),
    )


def _named(o, *keys: str):
    """Some of ``keys`` is a field of the JSON object o, null values included."""
    return F.coalesce(F.arrays_overlap(F.map_keys(o), T.words(*keys)), F.lit(False))


def sniff(files: DataFrame) -> DataFrame:
    """files(id, text) with the format that each looks like.

    Lines that all begin an object are a log or records; blank lines, and so a last newline, do not count. One
    object, or the first object of a list, tells by its fields. What is no JSON is a transcript.
    """
    f = _once(files.withColumn("_t", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")))
    t, listed, braced = F.col("_t"), F.startswith("_t", F.lit("[")), F.startswith("_t", F.lit("{"))
    lines = F.filter(F.transform(F.split(t, r"\r?\n|\r"), lambda x: F.regexp_replace(x, r"^\s+", "")), lambda x: x != "")
    f = f.withColumn("_lines", F.when(braced, lines)).withColumn("_list", F.from_json(F.when(listed, t), "array<string>"))
    lines, each = F.col("_lines"), (F.size("_lines") > 1) & F.forall("_lines", lambda x: F.startswith(x, F.lit("{")))
    log = F.array_join(F.slice(lines, 1, 60), "\n").rlike(r'"isSidechain"|"type": ?"response_item"')
    items = F.filter("_list", lambda x: F.startswith(F.ltrim(x), F.lit("{")))
    f = _once(f.select(*files.columns, "_t", F.coalesce(each, F.lit(False)).alias("_each"), F.when(each, log).alias("_log"), F.col("_list").isNotNull().alias("_listed"), F.from_json(F.when(listed, F.get(items, F.lit(0))).when(braced, t), MAP).alias("_one")))
    each, log, one = F.col("_each"), F.col("_log"), F.coalesce("_one", F.from_json(F.lit("{}"), MAP))
    said = _named(one, "role", "speaker", "author", "from") & _named(one, "content", "text", "message", "body")
    tree = _named(one, "mapping") | (~listed & _named(one, "conversations"))
    flat = ~said | _named(one, "session_id", "conversation_id", "thread_id") | ~listed
    whole = F.when(listed, F.col("_listed")).otherwise(F.col("_one").isNotNull())
    kind = (
        F.when(~F.coalesce(t.rlike(r"^[\[{]"), F.lit(False)), "transcript")
        .when(each, F.when(log, "agent_session").otherwise("jsonl"))
        .when(~whole, "transcript")
        .when(tree, "chatgpt")
        .when(_named(one, "messages"), "messages")
        .when(flat, "records")
        .otherwise("messages")
    )
    return _once(f.select(*files.columns, kind.alias("format")))


def render(messages: DataFrame, roles: bool = True) -> DataFrame:
    """(session_id, body, start_time): the turns as text under the session's title."""
    line = F.concat(F.col("speaker"), F.lit(": "), F.trim("content")) if roles else F.trim("content")
    g = messages.where(F.trim("content") != "").groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"),
        F.min_by("event_time", F.when(F.col("event_time").isNotNull(), F.col("pos"))).alias("start_time"), F.max("title").alias("title"),
    )
    return g.select("session_id", F.when(F.trim("title") != "", F.concat(F.lit("# "), F.trim("title"), F.lit("\n"), F.col("b"))).otherwise(F.col("b")).alias("body"), "start_time")


def import_episodes(messages: DataFrame, user: str, landed: DataFrame | None = None, base: float = 0.0) -> DataFrame:
    """Episodes of sessions that are not known yet: landed(fingerprint) are left out. A session with
    several distinct times becomes one episode a message; a missing time is base + a day per session."""
    split = messages.groupBy("session_id").agg(F.countDistinct("event_time").alias("times"), F.max(F.col("source").isin("records", "sessions")).alias("own"))
    parts = split.where((F.col("times") > 1) & F.col("own")).select("session_id")
    single = render(messages.join(parts, "session_id", "left_anti")).withColumn("pos", F.lit(0))
    each = messages.join(parts, "session_id").select("session_id", F.concat(F.col("speaker"), F.lit(": "), F.trim("content")).alias("body"), F.col("event_time").alias("start_time"), "pos")
    every = single.unionByName(each).withColumn("fingerprint", T.fingerprint(F.lit(user), F.col("session_id"), F.col("pos").cast("string"), F.col("body")))
    if landed is not None:
        every = every.join(landed.select("fingerprint"), "fingerprint", "left_anti")
    days = spread_rank(every.select("session_id").distinct(), [F.asc("session_id")], out="day").withColumn("day", F.col("day") - 1)
    at = F.coalesce("start_time", F.lit(base) + F.col("day") * T.DAY + F.col("pos"))
    return every.join(days, "session_id").select(
        F.concat(F.lit("ep_"), F.left("fingerprint", F.lit(12))).alias("episode_id"), F.lit(user).alias("user_id"), "session_id", F.col("body").alias("content"), at.alias("event_time"), "fingerprint"
    )


READERS = {"messages": chat_array, "records": records, "jsonl": records, "chatgpt": chat_export, "transcript": transcript, "agent_session": agent_log}


def parse(data: DataFrame, format: str, **kw) -> DataFrame:
    """Dispatch by format name."""
    if format not in READERS:
        raise ValueError(f"unknown format {format!r}; one of {sorted(READERS)}")
    return READERS[format](data, **kw)


def read_any(files: DataFrame, session_id: str = "imported") -> DataFrame:
    """files(id, text) of any known format, each read by what it looks like; sessions without a name are told apart by
    the file they came from."""
    f = written(sniff(files))  # told apart once, not once for each reader
    of = lambda *kinds: f.where(F.col("format").isin(*kinds))
    name = F.concat(F.lit(f"{session_id}_"), F.col("id"))
    lines = lambda df: df.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    chats = of("chatgpt").select("id", F.col("text").alias("json"))
    wrapped = F.coalesce(F.from_json("json", MAP)["conversations"], F.when(F.startswith(F.ltrim("json"), F.lit("[")), F.col("json")), F.concat(F.lit("["), F.col("json"), F.lit("]")))
    many = chats.select("id", F.posexplode(F.from_json(wrapped, "array<string>")).alias("n", "json"))
    many = many.select((F.xxhash64("id", "n")).alias("i"), "json")
    arrays = of("messages").select("id", F.col("text").alias("json"))
    bare = F.startswith(F.regexp_replace("text", r"^\s+", ""), F.lit("{"))  # one record without a list
    records_of = F.when(bare, F.array("text")).otherwise(F.from_json("text", "array<string>"))
    listed = of("records").select("id", F.posexplode(records_of).alias("seq", "json"))
    rows = lines(of("jsonl")).where(F.trim("line") != "").select("id", F.col("line_no").alias("seq"), F.col("line").alias("json"))
    logs = lines(of("agent_session")).select(name.alias("session_id"), "line_no", "line")
    parts = [chat_export(many), agent_log(logs)]
    parts += [_by_file(chat_array(arrays, "\x00"), session_id), _by_file(transcript(lines(of("transcript")), "\x00"), session_id)]
    parts += [_by_file(records(listed.unionByName(rows), "\x00"), session_id)]
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out


def _by_file(messages: DataFrame, session_id: str) -> DataFrame:
    """Sessions that a reader could not name, by their file's id."""
    named = F.regexp_replace("session_id", "^\x00", "")
    nameless = F.startswith("session_id", F.lit("\x00"))
    return messages.withColumn("session_id", F.when(nameless, F.concat(F.lit(f"{session_id}_"), F.col("id"), named)).otherwise(F.col("session_id")))
