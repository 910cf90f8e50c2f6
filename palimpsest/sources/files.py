"""Files and benchmark sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T


def find_sessions(spark: SparkSession, root: str, since: str | None = None, min_bytes: int = 2048, limit: int | None = None) -> DataFrame:
    """(path, length, modified) of session logs below ``root``, newest first; agents' own logs are left out.
    Only file listings are read, not their content."""
    src = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    files = (src.option("modifiedAfter", since) if since else src).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.where((F.col("length") >= min_bytes) & ~F.startswith(name, F.lit("agent-"))).select("path", "length", F.col("modificationTime").alias("modified"))
    out = out.orderBy(F.desc("modified"), "path")
    return out.limit(limit) if limit else out


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, text): text of plain and DOCX documents; PDF and images keep a null text for an extractor to fill."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = T.document_kind(F.hex(F.substring("content", 1, 8)), F.col("path"), F.lit(None).cast("string"))
    plain = F.trim(F.expr("try_validate_utf8(cast(content as string))"))
    text = F.when(F.col("kind") == "text", plain).when(F.col("kind") == "docx", docx_text(F.when(F.col("kind") == "docx", F.col("content"))))
    return files.select("path", "content", kind.alias("kind")).select("path", "kind", text.alias("text"))


def docx_text(content):
    """Paragraphs of a DOCX file, which is a zip with one XML part for its text; null for what is none."""
    import io
    import re
    import zipfile
    from html import unescape

    def one(data) -> str | None:
        if data is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                xml = z.read("word/document.xml").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError):
            return None
        paragraphs = ("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p)) for p in re.split(r"</w:p>", xml))
        return unescape("\n".join(p for p in paragraphs if p.strip()))

    @F.pandas_udf("string")
    def texts(data: pd.Series) -> pd.Series:
        return data.map(one, na_action="ignore")

    return texts(content)


def write_results(results: DataFrame, summary: DataFrame, path: str) -> None:
    """A benchmark's rows as JSON lines, and its summary row beside them."""
    results.write.mode("overwrite").json(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def caption(images: DataFrame, model=None) -> DataFrame:
    """images(path, content) with a caption: the model's, or a placeholder."""
    if model is None:
        return images.withColumn("caption", F.concat(F.lit("[image: "), F.element_at(F.split("path", "/"), -1), F.lit("]")))

    @F.pandas_udf("string")
    def said(content):
        return content.map(model)

    return images.withColumn("caption", said("content"))


def long_memory_items(spark: SparkSession, path: str) -> DataFrame:
    """Question sets with haystacks of dated sessions: (question_id, session_id, date, role, content)."""
    raw = spark.read.json(path, multiLine=True)
    z = raw.select("question_id", "question", "answer", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("i", "s"))
    turns = z.select("question_id", "i", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("date"), F.posexplode("s.haystack_sessions").alias("pos", "m"))
    return turns.select("question_id", "session_id", T.to_epoch(F.col("date")).alias("event_time"), "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def numbered_sessions(samples: DataFrame) -> DataFrame:
    """samples(id, conversation as map of 'session_N' to JSON turns): turns in the order of N; captions stand in the text."""
    s = samples.select("id", F.explode("conversation").alias("name", "json")).where(F.col("name").rlike(r"^session_\d+$"))
    s = s.withColumn("n", F.regexp_extract("name", r"session_(\d+)", 1).cast("int"))
    turns = s.select("id", "n", F.posexplode(F.from_json("json", "array<map<string,string>>")).alias("pos", "t"))
    cap = F.when(F.col("t.blip_caption").isNotNull(), F.concat(F.lit(" [shared image: "), F.col("t.blip_caption"), F.lit("]"))).otherwise("")
    return turns.select("id", "n", "pos", F.col("t.speaker").alias("speaker"), F.concat(F.col("t.text"), cap).alias("text")).orderBy("id", "n", "pos")


def persona_sample(rows: DataFrame, personas: int, per_persona: int, seed: int = 0) -> DataFrame:
    """``per_persona`` rows of ``personas`` personas, in an order that the seed fixes."""
    from pyspark.sql import Window as W

    who = rows.select("persona_id").distinct().orderBy(F.xxhash64(F.lit(seed), "persona_id")).limit(personas)
    w = W.partitionBy("persona_id").orderBy(F.xxhash64(F.lit(seed), "persona_id", "question_id"))
    return rows.join(who, "persona_id").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_persona).drop("_rn")


def result_log(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark logs {qid, cat, sys: {name: {...}}} as a row per question and system."""
    verdict = "map<string,struct<ok:boolean,tok:bigint,lat:double,err:string,pred:string,gold:string>>"
    rows = spark.read.schema(f"qid string, cat string, sys {verdict}").json(path)
    return rows.select("qid", "cat", F.explode("sys").alias("system", "v")).select("qid", "cat", "system", "v.*")
