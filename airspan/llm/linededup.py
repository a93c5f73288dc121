"""Boilerplate lines that stand on many sites.

A line is known by 92 bits of hashes of its trimmed text. The lines of all documents are split and hashed once, into
a saved frame of a few numbers per line. A cheap aggregate of counts and least and greatest site leaves out lines of a
single site; the others are common lines.

Copies of a document on many sites are no boilerplate, although all their lines stand there. So texts vote in
classes. With regard to a line, a text is a class of its own, unless common lines are more than half of what else it
has: then it may be an edited copy, and its class is the least (by hash) of its other common lines, which
edited copies share. A class votes for one site, the least of its documents'. So a line needs texts that have
little but the line in common; once it has them, it goes from every document.

For each line a HyperLogLog sketch collects the sites voted for; sketches are merged by the aggregate, in each task
first, so a line that stands in a third of all documents costs no more than any other. Where the estimate is too
near the threshold to decide, the sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airspan.llm.quality import fresh
from airspan.session import durable

LG_BUCKETS = 12
# Standard error of a sketch of 2 ** LG_BUCKETS buckets.
ERROR = 1.04 / 2 ** (LG_BUCKETS / 2)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _number(text: Column) -> Column:
    """The first 60 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(t, pos, h, b, n, site, whole) of each line with something in it: what names its text, its place, its hash in
    two parts, its length, the number of its site, and the length of all different lines of its text."""
    clean = F.transform(_lines(F.col(text)), lambda line: F.trim(F.translate(line, "\t\n\x0b\x0c\r", "     ")))
    lines = F.transform(clean, lambda x, i: F.struct(
        F.struct(_number(x.cast("binary")).alias("h"), F.crc32(x.cast("binary")).alias("b"), F.length(x).alias("n")).alias("k"),
        i.alias("pos")))
    df = docs.select(text_key(F.col(text)).alias("t"), _number(F.coalesce(F.col(site).cast("string"), F.lit(""))).alias("site"),
                     F.filter(lines, lambda x: x.k.n > 0).alias("lines"))
    whole = F.aggregate(F.array_distinct("lines.k"), F.lit(0).cast("long"), lambda s, x: s + x.n)
    return df.select("t", "site", whole.alias("whole"), F.explode("lines").alias("l")).select("t", "l.pos", "l.k.*", "site", "whole")


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("x"), F.crc32(text.cast("binary")).alias("c"))


def _sites(keyed: DataFrame, min_sites: int) -> DataFrame:
    common = durable(keyed.groupBy("h", "b").agg(
        F.count(F.lit(1)).alias("rows"), F.min("site").alias("x"), F.max("site").alias("y")).filter(
        (F.col("rows") >= min_sites) & ((F.col("x") != F.col("y")) | F.lit(min_sites <= 1))).select("h", "b"))
    # One row for each text, so that copies vote once, with its common lines.
    texts = keyed.join(common, ["h", "b"], "left_semi").groupBy("t").agg(
        F.collect_set(F.struct("h", "b", "n")).alias("lines"), F.min("site").alias("site"), F.first("whole").alias("whole"))
    texts = texts.select("t", "site", "whole", "lines", F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x.n).alias("shared"),
                         F.slice(F.array_sort(F.transform("lines", lambda x: x.h)), 1, 2).alias("least"))
    of = texts.select("*", F.explode("lines").alias("l")).select("*", "l.h", "l.b", "l.n")
    other = F.get("least", F.when(F.col("h") == F.get("least", F.lit(0)), 1).otherwise(0))
    copied = 2 * (F.col("shared") - F.col("n")) > F.col("whole") - F.col("n")
    votes = durable(of.select("h", "b", "site", copied.alias("copied"), F.when(copied, other).otherwise(F.col("t.x")).alias("class"))
                    .groupBy("h", "b", "copied", "class").agg(F.min("site").alias("site")))
    spread = durable(votes.groupBy("h", "b").agg(F.hll_sketch_estimate(
        F.hll_sketch_agg("site", F.lit(LG_BUCKETS))).alias("sites")))
    margin = F.greatest(F.lit(1.0), 5 * ERROR * F.col("sites"))
    unsure = spread.filter(F.abs(F.col("sites") - min_sites) <= margin)
    counted = votes.join(unsure.select("h", "b"), ["h", "b"], "left_semi").select("h", "b", "site").distinct().groupBy("h", "b").agg(
        F.count(F.lit(1)).alias("exact"))
    return (spread.join(counted, ["h", "b"], "left")
            .withColumn("sites", F.coalesce("exact", "sites")).filter(F.col("sites") >= min_sites)
            .select("h", "b", "sites", F.col("exact").isNotNull().alias("exact")))


def line_sites(docs: DataFrame, min_sites: int, text: str = "text", site: str = "source") -> DataFrame:
    """(h, b, sites, exact): the lines that at least ``min_sites`` sites are voted for, with the estimated or
    exact count. Empty lines are no lines; a null site is that of an empty name."""
    return _sites(durable(_keyed(docs, text, site)), min_sites)


def drop_boilerplate(docs: DataFrame, min_sites: int = 10, text: str = "text", site: str = "source",
                     removed: str | None = None) -> DataFrame:
    """The rows of ``docs`` with their columns, the boilerplate lines taken out of the text.

    A line that ``min_sites`` sites or more are voted for is boilerplate and goes from every document, be it a
    small part of its text or all of it. A null text stays null, a text without such lines is not changed. Repeated rows
    are all treated alike. ``removed`` names a column for the number of lines taken out.
    """
    names = docs.columns
    keyed = durable(_keyed(docs, text, site))
    spread = durable(_sites(keyed, min_sites).select("h", "b"))
    key, hits = fresh(docs, "line_key"), fresh(docs, "line_hits")
    # Copies of a text have the same lines, and each place is kept once.
    found = keyed.join(spread, ["h", "b"], "left_semi").groupBy("t").agg(F.collect_set("pos").alias(hits)).withColumnRenamed("t", key)
    out = docs.withColumn(key, text_key(F.col(text))).join(found, key, "left")
    # The lines as a column of their own, so that they are split once and not for each line kept.
    lines = fresh(docs, "line_texts")
    out = out.withColumn(lines, F.when(F.col(hits).isNotNull(), _lines(F.col(text))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(hits))
    left = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    cut = F.col(hits).isNotNull()
    new = F.when(cut, left).otherwise(F.col(text))
    gone = F.when(cut, F.size(hits)).otherwise(F.lit(0))
    return out.select(*[new.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in names],
                      *([gone.cast("long").alias(removed)] if removed else []))
