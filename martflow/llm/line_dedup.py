"""Boilerplate lines, by their frequency within a site.

For every site the pages that contain a line are divided by the pages of the
site; lines above a ratio are dropped from the site's pages.  A line is compared
without surrounding white space and known by its MD5 digest.  Lines are counted
once per page, and counts are combined before the shuffle, so a line or a site
with a third of all rows is no hot key.  A site's boilerplate is one array: with
L distinct lines a page on average it holds at most L / ratio digests.

Only functions of Spark are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from martflow.llm.common import Layers

# From the line frequencies per source of the test documents (README): lines that recur
# in every source reach below a hundredth of its pages; under 0.8 %, or on two pages,
# most repeated lines are those of copied documents, which have to keep one copy.
RATIO = 0.008   # a line on more than this share of a site's pages is boilerplate
MIN_PAGES = 3   # ... if it is on at least so many
_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def blocks_of(html: Column) -> Column:
    """The text of an HTML page, a line for each run between tags."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->", "\n")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")


def _line_keys(lines: Column) -> Column:
    """A digest for each line, null for blank ones."""
    def key(line):
        bare = F.regexp_replace(line, _EDGES, "")
        return F.when(bare != "", F.md5(bare.cast("binary")))
    return F.transform(lines, key)


def drop_boilerplate(pages: DataFrame, site: Column, text: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of ``pages`` with ``text`` cleaned, and ``n_lines`` and ``n_dropped`` (long).

    ``n_lines`` counts all lines (split at ``\\n``), blank ones too, and
    ``n_dropped`` those taken out; blank lines stay.  A null text stays null with
    0 lines, an empty one has one blank line.  Rows whose site is null are one
    site.  Repeated rows are pages of their own.  Columns of ``pages`` that clash
    with the two added names are replaced.
    """
    layers = Layers(pages.sparkSession, "line-dedup")
    lines = F.split(F.col(text), "\n", -1)
    keyed = pages.select(site.alias("_site"), F.array_distinct(_line_keys(lines)).alias("_keys"))
    counts = (keyed.select("_site", F.explode(F.array_compact("_keys")).alias("_key"))
              .groupBy("_site", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages))
    totals = pages.groupBy(site.alias("_of")).agg(F.count(F.lit(1)).alias("_pages"))
    often = (counts.join(totals, F.col("_site").eqNullSafe(F.col("_of")))
             .where(F.col("_n") > F.col("_pages") * F.lit(ratio))
             .groupBy("_of").agg(F.collect_set("_key").alias("_often")))
    often = layers.write(often)

    kept = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    # Columns travel under numbers, so that none clashes with those added here.
    named = pages.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(kept)], site.alias("_site"), lines.alias("_lines"))
    marked = (named.join(often, F.col("_site").eqNullSafe(F.col("_of")), "left")
              .withColumn("_keys", F.when(F.col("_often").isNotNull(), _line_keys(F.col("_lines"))))
              .withColumn("_hit", F.array_intersect("_keys", "_often")))
    stay = F.filter(F.col("_lines"), lambda x, i: ~F.coalesce(
        F.array_contains(F.col("_hit"), F.get(F.col("_keys"), i)), F.lit(False)))
    hit = F.size(F.coalesce("_hit", F.array().cast("array<string>"))) > 0
    marked = marked.withColumn("_stay", F.when(hit, stay))
    n = F.coalesce(F.size("_lines"), F.lit(0)).cast("long")
    n = F.when(F.col("_lines").isNull(), F.lit(0).cast("long")).otherwise(n)
    return marked.select(
        *[(F.when(F.col("_stay").isNotNull(), F.array_join("_stay", "\n")).otherwise(F.col(f"in_{i}")) if c == text
           else F.col(f"in_{i}")).alias(c) for i, c in enumerate(kept)],
        n.alias("n_lines"),
        F.when(hit, n - F.size("_stay")).otherwise(F.lit(0)).cast("long").alias("n_dropped"))
