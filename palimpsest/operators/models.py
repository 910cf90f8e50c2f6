"""Where models plug in: cached calls, embedding, reranking, extraction, and tolerant reading of their output.

A model is a callable that is shipped to the workers; tests pass deterministic ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CACHE = "key string, answer string"


def cache_key(model: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(model), *parts), 256)


def complete(prompts: DataFrame, model: Callable[[str], str], name: str = "model", cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """prompts(prompt, ...) with answers, and the cache with the new ones: each distinct prompt that the
    cache lacks is asked once, and an empty answer is not remembered."""
    keyed = prompts.withColumn("key", cache_key(name, F.col("prompt")))
    known = cache if cache is not None else prompts.sparkSession.createDataFrame([], CACHE)
    todo = keyed.select("key", "prompt").dropDuplicates(["key"]).join(known, "key", "left_anti")

    def ask(parts):
        for p in parts:
            yield pd.DataFrame({"key": p["key"], "answer": [model(x) for x in p["prompt"]]})

    new = todo.mapInPandas(ask, CACHE).where("answer <> ''")
    full = known.unionByName(new)
    return keyed.join(full, "key", "left").drop("key"), full


def embed(table: DataFrame, model: Callable[[list[str]], list[list[float]]], text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Vectors of a text column, a batch at a time."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())])

    return table.withColumn(out, vectors(F.col(text_col)))


def rerank(candidates: DataFrame, model: Callable[[str, str], float], k: int) -> DataFrame:
    """candidates(qid, query, id, text): the k best of each question by the model's score."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([float(model(a, b)) for a, b in zip(q, t, strict=True)])

    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return candidates.withColumn("score", score("query", "text")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def salvage(raw: str) -> list[dict]:
    """Objects in a model's output: fences are taken off, and of a list that was cut short the whole objects count."""
    text = re.sub(r"^\s*```(?:json)?|```\s*$", "", raw or "").strip()
    try:
        got = json.loads(text)
        return [x for x in (got if isinstance(got, list) else got.get("facts", [got])) if isinstance(x, dict)]
    except (ValueError, AttributeError):
        pass
    out, at, read = [], 0, json.JSONDecoder()
    while (at := text.find("{", at)) >= 0:
        try:
            x, at = read.raw_decode(text, at)
            if isinstance(x, dict):
                out.append(x)
        except ValueError:
            at += 1
    return out


def facts_from_output(answers: DataFrame) -> DataFrame:
    """answers(episode_id, answer) as triples; whatever lacks one of the three parts goes."""

    @F.pandas_udf("array<struct<subject:string,predicate:string,object:string>>")
    def read(raw: pd.Series) -> pd.Series:
        keep = lambda x: {k: str(x[k]).strip() for k in ("subject", "predicate", "object")}
        return raw.map(lambda r: [keep(x) for x in salvage(r) if all(str(x.get(k) or "").strip() for k in ("subject", "predicate", "object"))])

    return answers.select("episode_id", F.explode(read("answer")).alias("f")).select("episode_id", "f.*")


# fixed values: what a distilled conclusion may be
LEAST, MOST, KEY = 15, 400, 120


def outcomes(answers: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """answers(session_id, kind, statement, why): conclusions of a fitting length, each once by its first
    120 characters, as text with its grounds."""
    s = F.trim("statement")
    rows = answers.where(F.col("kind").isin(*kinds) & F.length(s).between(LEAST, MOST))
    text = F.when(F.coalesce(F.trim("why"), F.lit("")) != "", F.concat(s, F.lit(" （依据："), F.trim("why"), F.lit("）"))).otherwise(s)
    key = F.left(F.lower(F.regexp_replace(s, r"\s+", " ")), F.lit(KEY))
    one = rows.withColumn("text", text).groupBy("session_id", "kind", key.alias("_k")).agg(F.min("text").alias("text"))
    return one.drop("_k")
