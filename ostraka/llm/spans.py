"""Long exact spans shared between records, by hashing units and grouping digests globally.

The unit is a window of ``length`` consecutive tokens: a token lies in a shared run of at least
``length`` tokens exactly when one of its windows stands in another record too. Every window of
every record is hashed to 128 bits, digests are grouped over the whole collection with map-side
partial aggregation (a digest is shared when its smallest and largest record differ, so a hot
passage needs two numbers, never a list), and the shared windows come back to their records by
an equi-join that adaptive execution splits where a passage is hot. The earliest ranked
occurrence of a digest can be kept and the later ones removed, with their original offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import pieces
from ..storage import Scratch


def renderings(failures: DataFrame) -> DataFrame:
    """(fragment_id, tokens): one row per fragment with a rendering, of the query or the predicted side.

    Renderings of one fragment are the same but for white space; if they should differ, the
    greatest by code points is taken. Null ids and null or blank renderings give no row.
    """
    sides = failures.select(F.explode(F.array(
        F.struct(F.col("query_id").alias("fragment_id"), F.col("query_rendering").alias("r")),
        F.struct(F.col("predicted").alias("fragment_id"), F.col("predicted_rendering").alias("r")),
    )).alias("s")).select("s.fragment_id", F.array_join(pieces(F.col("s.r")), " ").alias("text"))
    one = sides.where("fragment_id is not null and text <> ''").groupBy("fragment_id").agg(F.max("text").alias("text"))
    return one.select("fragment_id", F.split("text", " ").alias("tokens"))


def _windows(records: DataFrame, length: int) -> DataFrame:
    """(rid, pos, h1, h2) of every window, from (rid, tokens)."""
    hashed = records.where(F.size("tokens") >= length).select("rid", F.transform("tokens", lambda t: F.xxhash64(t)).alias("t"))
    at = F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("t") - (length - 1)),
        lambda i: F.struct(
            F.xxhash64(F.slice("t", i, length)).alias("h1"),
            F.xxhash64(F.lit(7), F.slice("t", i, length)).alias("h2"),
        ),
    )).alias("pos", "w")
    return hashed.select("rid", at).select("rid", "pos", "w.h1", "w.h2")


def _runs(positions: Column, length: int) -> Column:
    """Maximal runs of covered tokens from sorted window positions: touching windows are one run."""
    p = positions
    begin = F.filter(p, lambda x, i: (i == 0) | (x - F.get(p, i - 1) > length))
    end = F.transform(F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) - x > length)), lambda x: x + (length - 1))
    return F.arrays_zip(begin.alias("s"), end.alias("e"))


def _numbered(records: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    return scratch.cut(records.select(F.monotonically_increasing_id().alias("rid"), key, "tokens"), "records")


def shared_spans(records: DataFrame, key: str = "fragment_id", length: int = 15) -> DataFrame:
    """(``key``, start_tok, end_tok): the maximal runs of tokens covered by shared spans.

    ``records`` has one row per ``key`` with an array ``tokens``; a token is covered if it lies
    in a run of at least ``length`` tokens that stands, token for token, in another record. A
    repetition within one record alone does not count. Records shorter than ``length`` and
    empty tables give no rows. Tokens count from 0, both ends included.
    """
    return _spans_of(_numbered(records, key, Scratch(records.sparkSession, "spans")), key, length)


def _spans_of(table: DataFrame, key: str, length: int) -> DataFrame:
    """``shared_spans`` of a written table (rid, ``key``, tokens)."""
    windows = _windows(table.select("rid", "tokens"), length)
    shared = windows.groupBy("h1", "h2").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("h1", "h2")
    covered = windows.join(shared, ["h1", "h2"]).groupBy("rid").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    runs = covered.select("rid", F.explode(_runs(F.col("p"), length)).alias("r"))
    return runs.join(table.select("rid", key), "rid").select(key, F.col("r.s").cast("int").alias("start_tok"), F.col("r.e").cast("int").alias("end_tok"))


def shared_fraction(records: DataFrame, key: str = "fragment_id", length: int = 15) -> DataFrame:
    """(``key``, n_tokens, shared_tokens, share): how much of each record stands elsewhere too; every record has a row."""
    table = _numbered(records, key, Scratch(records.sparkSession, "share"))
    spans = _spans_of(table, key, length).groupBy(key).agg(F.sum(F.expr("end_tok - start_tok + 1")).alias("n"))
    sized = table.select(key, F.size("tokens").cast("long").alias("n_tokens")).join(spans, key, "left")
    return sized.select(key, "n_tokens", F.coalesce("n", F.lit(0)).cast("long").alias("shared_tokens")).withColumn(
        "share", F.when(F.col("n_tokens") > 0, F.round(F.col("shared_tokens") / F.col("n_tokens"), 6)).otherwise(F.lit(0.0)))


def later_occurrences(records: DataFrame, key: str = "fragment_id", length: int = 15) -> DataFrame:
    """(``key``, start_tok, end_tok): what to remove so that each shared unit stays at its earliest occurrence only.

    Occurrences rank by record id (code points), then by position; offsets are those of the
    original record. Repetitions within one record are removed too.
    """
    scratch = Scratch(records.sparkSession, "later")
    # a sort by the key makes the running number follow the rank
    table = _numbered(records.orderBy(key), key, scratch)
    windows = _windows(table.select("rid", "tokens"), length)
    kept = windows.groupBy("h1", "h2").agg(F.min(F.struct("rid", "pos")).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = kept.select("h1", "h2", F.col("k.rid").alias("krid"), F.col("k.pos").alias("kpos"))
    removed = windows.join(kept, ["h1", "h2"]).where("rid <> krid or pos <> kpos")
    found = removed.groupBy("rid").agg(F.array_sort(F.collect_list("pos")).alias("p")).select("rid", F.explode(_runs(F.col("p"), length)).alias("r"))
    return found.join(table.select("rid", key), "rid").select(key, F.col("r.s").cast("int").alias("start_tok"), F.col("r.e").cast("int").alias("end_tok"))
