"""URL filters by association rules. Only DataFrame functions and FP-growth.

Labelled urls become baskets of tokens and one item for their label. FP-growth finds
the frequent token sets; rules "tokens => bad" above a confidence are kept, those that
a smaller kept rule already implies are pruned, and each is filed under its rarest
token. A url meets only the rules filed under its own tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# fixed values: the rules that the query applies
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Mining:
    """min_share of labelled urls that a token set must occur in, with at least min_rows of them.

    most_tokens bounds nothing that can be mined: a larger frequent set has 2**63 frequent subsets.
    """

    min_share: float = 0.002
    min_rows: int = 5
    min_confidence: float = 0.6
    most_tokens: int = 62


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    whole = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(whole, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the host's labels, and the runs of letters and digits of the path."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, words))


def mine_rules(labelled: DataFrame, mining: Mining) -> DataFrame:
    """(tokens, confidence, support, anchor) from (tokens, bad): rows of null ``bad`` take no part.

    The anchor is the rule's rarest token, ties to the smaller. Rules of over
    ``most_tokens`` tokens are not kept.
    """
    rows = labelled.where("bad IS NOT NULL AND tokens IS NOT NULL")
    basket = F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens"))
    baskets = durable(rows.select(basket.alias("items"), "bad"), "baskets")
    total = baskets.count()
    empty = "tokens array<string>, confidence double, support bigint, anchor string"
    if not total:
        return labelled.sparkSession.createDataFrame([], empty)
    share = min(1.0, max(mining.min_share, mining.min_rows / total))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=mining.min_confidence).fit(baskets)
    sets = durable(model.freqItemsets, "frequent-sets")
    found = sets.where(F.array_contains("items", BAD) & F.size("items").between(2, mining.most_tokens + 1))
    found = found.select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("support"))
    base = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    rules = found.join(base, "tokens").withColumn("confidence", F.col("support") / F.col("n"))
    rules = durable(rules.where(F.col("confidence") >= mining.min_confidence).select("tokens", "confidence", "support"), "rules")
    one = base.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("t"), "n")
    spread = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("t"))
    rare = spread.join(one, "t").groupBy("tokens", "confidence", "support").agg(F.min(F.struct("n", "t")).alias("m"))
    filed = durable(rare.select("tokens", "confidence", "support", F.col("m.t").alias("anchor")), "filed-rules")
    short = filed.select(F.col("tokens").alias("small"), F.col("anchor").alias("t"))
    wide = spread.select("tokens", "t").join(short, "t")
    implied = wide.where((F.size("small") < F.size("tokens")) & (F.size(F.array_except("small", "tokens")) == 0)).select("tokens").distinct()
    return filed.join(implied, "tokens", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The ``key`` of each row of urls(key, tokens) whose tokens hold all of some rule's."""
    spread = urls.select("key", "tokens", F.explode("tokens").alias("anchor"))
    index = rules.select("anchor", F.col("tokens").alias("rule"))
    return spread.join(index, "anchor").where(F.size(F.array_except("rule", "tokens")) == 0).select("key").distinct()


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, mining: Mining | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``pages`` with host, path, rule and verdict ('allow' or 'block').

    ``labels`` has (id, bad) for some pages; repeated labels of an id count as bad if any
    is. A page without a fitting rule is blocked if a mined rule matches its url, and
    else allowed; so is a null url. Repeated urls are judged once.
    """
    mining = mining or Mining()
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    parts = pages.select(*[F.col(f"`{c}`") for c in keep]).withColumn("_host", host).withColumn("_path", path)
    said = labels.toDF("_id", "_bad").where("_id IS NOT NULL AND _bad IS NOT NULL").groupBy("_id").agg(F.max("_bad").alias("bad"))
    tokens = url_tokens(F.col("_host"), F.col("_path"))
    taught = parts.select(F.col(f"`{id_col}`").alias("_id"), tokens.alias("tokens")).join(said, "_id").select("tokens", "bad")
    mined = mine_rules(taught, mining)
    key = F.struct("_host", "_path")
    hit = match_rules(parts.select(key.alias("key")).distinct().select("key", url_tokens(F.col("key._host"), F.col("key._path")).alias("tokens")), mined)
    hit = hit.select(F.col("key._host").alias("_host"), F.col("key._path").alias("_path"), F.lit(True).alias("_hit"))
    out = parts.join(hit, ["_host", "_path"], "left").withColumn("_rule", longest_rule(F.col("_host"), F.col("_path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_hit"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(
        *[F.col(f"`{c}`") for c in keep], F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict")
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """A label is bad at quality 0 or toxic 1; labels belong to the page of their number."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.expr("quality = 0 OR toxic = 1").alias("bad"))
    return filter_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(rules: tuple[Rule, ...], what: str) -> str:
    cases = []
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        cases.append(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'")
    return "CASE " + " ".join(cases) + " END"


OP4_SQL = f"""
WITH RECURSIVE u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (
  SELECT *, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(regexp_split_to_array(lower(path), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'p:' || x))) AS tokens
  FROM p),
l AS (SELECT doc_id, max(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
b AS (SELECT row_number() OVER () AS i, tokens, bad FROM k JOIN l ON page_id = doc_id WHERE bad IS NOT NULL),
m AS (SELECT greatest(5, ceil(0.002 * count(*))) AS least FROM b),
t AS (SELECT i, bad, unnest(tokens) AS a FROM b),
f AS (SELECT i, bad, a FROM t JOIN (SELECT a FROM t, m GROUP BY a, least HAVING count(*) >= least) USING (a)),
s AS (SELECT i, bad, [a] AS rule, a FROM f UNION ALL
      SELECT s.i, s.bad, list_append(s.rule, f.a), f.a FROM s JOIN f ON s.i = f.i AND s.a < f.a),
c AS (SELECT rule, count(*) AS n, count(*) FILTER (WHERE bad) AS y FROM s GROUP BY rule),
r AS (SELECT rule FROM c, m WHERE y >= least AND y / n >= 0.6),
h AS (SELECT DISTINCT page_id, tokens FROM k JOIN r ON list_has_all(tokens, rule))
SELECT page_id, host, path, {_rule_sql(RULES, "text")} AS rule,
       coalesce({_rule_sql(RULES, "verdict")}, CASE WHEN page_id IN (SELECT page_id FROM h) THEN 'block' ELSE 'allow' END) AS verdict
FROM k
"""
