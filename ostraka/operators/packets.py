"""Packets of evidence for a reader: what was proposed and decided, without the hidden answer, bound by a hash, and their validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a packet may decide.
OUTCOMES = ("abstain_no_anchor_evidence", "abstain_evidence_tie", "abstain_calibrated_threshold", "accepted_exact_agreement", "accepted_variant")
SHOWN = {"accepted_exact_agreement": "present_one", "accepted_variant": "present_one"}


def body(spans: DataFrame, key: list[str]) -> DataFrame:
    """(``key``, action, body, sha): a packet as JSON with its fields in a fixed order, and the SHA-256 of that text.

    ``spans`` has the keys, n_alt, total, outcome and first, a list of (m, support). The gold reading and whether
    it was met are no part of a packet: of the outcome only the action is told.
    """
    action = F.when(F.col("outcome").isin(*SHOWN), "present_one").otherwise("abstain")
    shown = F.transform("first", lambda x: F.struct(x["m"].alias("reading"), x["support"].alias("families")))
    packet = F.to_json(F.struct(F.struct(*key).alias("span"), F.col("n_alt").alias("alternatives"), F.col("total").alias("votes"), shown.alias("shown"), action.alias("action")))
    return spans.select(*key, action.alias("action"), packet.alias("body")).withColumn("sha", F.sha2("body", 256))


def packet_faults(packets: DataFrame) -> DataFrame:
    """(fault, packets): how many packets break each invariant, of (body, action, sha)."""
    schema = "span map<string,string>, alternatives long, votes long, shown array<struct<reading:string,families:long>>, action string"
    p = packets.withColumn("p", F.from_json("body", schema))
    shown = F.col("p.shown")
    families = F.transform(shown, lambda x: x["families"])
    checks: dict[str, Column] = {
        "unreadable": F.col("p.action").isNull(),
        "hash_not_of_body": F.col("sha") != F.sha2("body", 256),
        "action_differs": F.col("p.action") != F.col("action"),
        "answer_in_packet": F.col("body").rlike('"(gold|exact|agreement|answer)"'),
        "more_shown_than_exist": F.size(shown) > F.col("p.alternatives"),
        "order_broken": ~(families == F.sort_array(families, asc=False)),
        "votes_beyond_total": F.aggregate(families, F.lit(0).cast("long"), lambda a, x: a + x) > F.col("p.votes"),
        "reading_twice": F.size(F.array_distinct(F.transform(shown, lambda x: x["reading"]))) < F.size(shown),
        "empty_support": F.exists(families, lambda x: x < 1),
        "presented_nothing": (F.col("p.action") == "present_one") & (F.size(shown) == 0),
    }
    one = p.agg(*[F.count_if(F.coalesce(c, F.lit(name != "unreadable"))).alias(name) for name, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fault"), F.col(n).alias("packets")) for n in checks])).alias("x")).select("x.fault", "x.packets")
