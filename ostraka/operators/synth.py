"""Synthetic fragment pairs: deterministic cuts and erosion of documents, driven by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chance of lost lines at a cut, share of a line by which a cut strays, tokens lost at it, lines near an edge, and the least size of a document.
GAP_RATE, JITTER, MOST_ERODED, EDGE_LINES = 0.4, 0.15, 2, 2
MIN_LINES, MIN_SIGNS = 8, 60


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) drawn from the first 32 bits of the MD5 of seed and keys, so that other engines draw the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def vertical_cuts(docs: DataFrame, seed: int, min_lines: int = MIN_LINES, gap_rate: float = GAP_RATE) -> DataFrame:
    """(doc_id, upper, lower, gap): lines above and below a drawn boundary; sometimes lines between are lost.

    ``docs`` has doc_id and lines (an array). Documents of fewer lines give no pair.
    """
    n = F.size("lines")
    at = (F.floor(uniform(seed, F.col("doc_id")) * (n - 2)) + 1).cast("int")
    lost = F.when(uniform(seed + 1, F.col("doc_id")) < gap_rate, 1 + F.floor(uniform(seed + 2, F.col("doc_id")) * 2)).otherwise(0).cast("int")
    cut = docs.where(n >= min_lines).withColumn("at", at).withColumn("gap", F.least(lost, n - at - 1))
    return cut.select("doc_id", F.slice("lines", F.lit(1), F.col("at")).alias("upper"), F.slice("lines", F.col("at") + F.col("gap") + 1, n).alias("lower"), "gap")


def horizontal_cuts(lines: DataFrame, seed: int, middle: float = 0.5) -> DataFrame:
    """(doc_id, line, left, right, eroded): each line cut near ``middle``, strayed by up to ``JITTER`` of its length; up to ``MOST_ERODED`` tokens are lost on either side.

    ``lines`` has doc_id, line and tokens.
    """
    n, key = F.size("tokens"), (F.col("doc_id"), F.col("line"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), middle + JITTER * (2 * uniform(seed, *key) - 1)))
    most = F.least(F.lit(MOST_ERODED), F.greatest(F.lit(0), n - 1))
    cut = lines.withColumn("at", F.round(share * n).cast("int")).withColumn("eroded", F.floor(uniform(seed + 1, *key) * (most + 1)).cast("int"))
    keep = F.greatest(F.lit(0), F.col("at") - F.col("eroded"))
    return cut.select("doc_id", "line", F.slice("tokens", F.lit(1), keep).alias("left"), F.slice("tokens", F.col("at") + F.col("eroded") + 1, n).alias("right"), "eroded")


def erode(tokens: Column, rate: Column | float, seed: int, *keys: Column) -> Column:
    """Tokens worn to ``x`` at a rate, drawn by place; what is worn stays worn."""
    chance = F.lit(rate) if isinstance(rate, float) else rate
    return F.transform(tokens, lambda t, i: F.when((t == "x") | (uniform(seed, *keys, i) < chance), F.lit("x")).otherwise(t))


def edge_rate(place: Column, lines: Column, rate: float) -> Column:
    """The rate of erosion of a line: twice the base near the first or last line of its document; ``place`` counts from 0."""
    return F.when((place < EDGE_LINES) | (place >= lines - EDGE_LINES), 2 * rate).otherwise(F.lit(rate))


def eligible(lines: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_signs): documents with lines and attested signs enough to be cut; ``lines`` has doc_id and tokens."""
    known = F.size(F.filter("tokens", lambda t: t != "x"))
    g = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(known).cast("long").alias("n_signs"))
    return g.where((F.col("n_lines") >= MIN_LINES) & (F.col("n_signs") >= MIN_SIGNS))


def views(lines: DataFrame, seed: int, rate: float, count: int) -> DataFrame:
    """(doc_id, line, view, tokens): ``count`` views of each line of eligible documents, eroded each by itself and more near the edges."""
    sized = lines.join(eligible(lines), "doc_id")
    from pyspark.sql.window import Window

    placed = sized.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1)
    each = placed.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(count))))
    worn = erode(F.col("tokens"), edge_rate(F.col("place"), F.col("n_lines"), rate), seed, F.col("doc_id"), F.col("line"), F.col("view"))
    return each.select("doc_id", "line", "view", worn.alias("tokens"))
