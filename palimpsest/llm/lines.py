"""Line dedup by distinct-site spread. Only DataFrame functions.

A line's key is two 64-bit hashes of its text without outer spaces; blank lines have none.
Lines that enough rows hold get a HyperLogLog sketch of their sites; where the
estimate is near the threshold the sites are counted exactly. Of a boilerplate line
the first occurrence (smallest id, then place) stays and the others go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import durable, settled

MIN_SITES = 10
LINE = ["h", "g"]  # the hashes of a line
LG_K = 12  # a sketch of 2**12 buckets: a standard error of 1.6 percent
NEAR = 0.06  # of the threshold on each side, almost four standard errors; one site at least


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _id, _null, _row (which tells unequal rows of one id apart) and _lines."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumns(
        {
            "_id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0).cast("long")),
            "_null": F.col(f"`{id_col}`").isNull(),
            "_row": F.xxhash64(text),
            "_lines": F.split(text, "\n"),
        }
    )


def _occurrences(keyed: DataFrame, site_col: str) -> DataFrame:
    at = keyed.select("_id", "_null", "_row", F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("")).alias("site"), F.posexplode("_lines").alias("pos", "line"))
    at = at.select("_id", "_null", "_row", "pos", "site", F.trim("line").alias("line")).where("line <> ''")
    return at.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")}).drop("line")


def boilerplate_lines(seen: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g, first) of the lines on at least ``min_sites`` distinct sites, from occurrences (h, g, site, at);
    first is the least ``at``. Sketches and first places of a hot line combine before the shuffle."""
    sketch = seen.groupBy(*LINE).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("at").alias("first"))
    about = durable(sketch.select(*LINE, "first", F.hll_sketch_estimate("sketch").alias("about")), "line-sites")
    margin = max(1.0, NEAR * min_sites)
    sure = about.where(F.col("about") > min_sites + margin).select(*LINE, "first")
    near = about.where(F.col("about").between(min_sites - margin, min_sites + margin)).select(*LINE, "first")
    exact = seen.join(near, LINE, "left_semi").select(*LINE, "site").distinct().groupBy(*LINE).agg(F.count(F.lit(1)).alias("n"))
    return sure.union(near.join(exact.where(F.col("n") >= min_sites), LINE).select(*LINE, "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten and two more columns, n_lines and n_removed.

    No row goes. A null text stays null, with one line; a null site is the site ''.
    Rows equal in id and text are one occurrence and are treated alike. A text whose
    lines have all gone is empty.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = _keyed(docs.select(*[F.col(f"`{c}`") for c in keep]), id_col, text_col)
    gone = settled(lambda: _later_places(_occurrences(keyed, site_col), min_sites), "boilerplate-places")
    whole = keyed.join(gone.hint("merge"), ["_id", "_null", "_row"], "left")  # grows with the corpus: the plan of a large one at any size
    edges = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size("_lines")))
    kept = F.expr("flatten(transform(sequence(0, size(_edges) - 2), i -> slice(_lines, _edges[i] + 2, _edges[i + 1] - _edges[i] - 1)))")
    text = F.when(F.col("_gone").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    out = whole.withColumn("_edges", edges).withColumn("_text", text)
    return out.select(
        *[F.col("_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in keep],
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )


def _later_places(seen: DataFrame, min_sites: int) -> DataFrame:
    """(_id, _null, _row, _gone): the places of boilerplate lines in each text, but for their first occurrences."""
    # distinct sites cannot outnumber rows: most lines end here, in one pre-aggregated count
    site = F.xxhash64("site")
    often = seen.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n"), F.min(site).alias("a"), F.max(site).alias("z"))
    often = often.where(F.col("n") >= min_sites)
    # written, so that both sides of the join are plain: it is broadcast by its size, or else a hot line's rows are split
    often = durable((often.where("a <> z") if min_sites > 1 else often).select(*LINE), "often-seen")
    kept = seen.join(often, LINE).select(*LINE, "site", F.struct("_null", "_id", "_row", "pos").alias("at"))
    seen = durable(kept, "often-seen-lines")
    common = durable(boilerplate_lines(seen, min_sites), "boilerplate")
    gone = seen.join(common, LINE).where(F.col("at") != F.col("first"))
    return gone.groupBy("at._id", "at._null", "at._row").agg(F.sort_array(F.collect_set("at.pos")).alias("_gone"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its numbers of lines and of boilerplate lines removed; null texts are empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP10_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT trim(line) AS key FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (
  SELECT l.doc_id, l.pos, l.line,
         k.key IS NOT NULL AND row_number() OVER (PARTITION BY trim(l.line) ORDER BY l.doc_id, l.pos) > 1 AS gone
  FROM l LEFT JOIN k ON trim(l.line) = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
"""
