"""Multinomial naive Bayes, all folds at once, from counts: nothing is fitted in a loop and no vocabulary is hashed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def folded(docs: DataFrame, key: str, label: str, folds: int) -> DataFrame:
    """``docs`` with a fold: the place within the label in the order of the key, modulo ``folds``."""
    return docs.withColumn("fold", (F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1) % folds)


def predicted(docs: DataFrame, key: str, label: str, smoothing: float = 1.0) -> DataFrame:
    """(``key``, fold, ``label``, guess): the label a model of the other folds gives each document; ties go to the first label.

    ``docs`` has the key, label, fold and tokens. Counts of a model are the totals less those of its own fold. Tokens that the other
    folds do not hold weigh alike for all labels but for their totals, as smoothing has it; labels unseen in the other folds are no guess.
    """
    names, (key, label) = (key, label), ("_key", "_label")  # no column of the caller's meets one made here
    docs = docs.select(F.col(names[0]).alias(key), "fold", F.col(names[1]).alias(label), "tokens")
    tf = docs.select(key, "fold", label, F.explode("tokens").alias("token")).groupBy(key, "fold", label, "token").agg(F.count(F.lit(1)).alias("tf"))
    per = tf.groupBy("fold", label, "token").agg(F.sum("tf").alias("c"))
    whole = per.groupBy(label, "token").agg(F.sum("c").alias("all"))
    size_fold, size_all = per.groupBy("fold", label).agg(F.sum("c").alias("nf")), per.groupBy(label).agg(F.sum("c").alias("na"))
    docs_fold, docs_all = docs.groupBy("fold", label).agg(F.count(F.lit(1)).alias("df")), docs.groupBy(label).agg(F.count(F.lit(1)).alias("da"))
    held = per.groupBy("token").agg(F.countDistinct("fold").alias("folds"), F.min("fold").alias("only"))
    # a fold's vocabulary misses the tokens that stand in that fold alone
    vocab = held.agg(F.count(F.lit(1)).alias("v"))
    lone = held.where("folds = 1").groupBy(F.col("only").alias("fold")).agg(F.count(F.lit(1)).alias("gone"))
    folds = docs.select("fold").distinct()
    # labels and folds are few, and so is their frame
    frame = folds.join(docs_all).join(size_all, label, "left").join(size_fold, ["fold", label], "left").join(docs_fold, ["fold", label], "left").join(lone, "fold", "left").join(F.broadcast(vocab))
    zero = lambda c: F.coalesce(c, F.lit(0))
    frame = frame.select(
        "fold", F.col(label).alias("guess"), (F.col("da") - zero("df")).alias("docs"), (zero("na") - zero("nf")).alias("n"), (F.col("v") - zero("gone")).alias("v")).where("docs > 0")
    total = frame.groupBy("fold").agg(F.sum("docs").alias("all_docs"))
    frame = frame.join(total, "fold").select("fold", "guess", F.log(F.col("docs") / F.col("all_docs")).alias("prior"), F.log(F.col("n") + smoothing * F.col("v")).alias("norm"))
    # what a token adds beyond the smoothing, where the label has it in the other folds
    own = per.select("fold", F.col(label).alias("guess"), "token", "c")
    seen = whole.withColumnRenamed(label, "guess").join(folds).join(own, ["fold", "guess", "token"], "left").select("fold", "guess", "token", (F.col("all") - zero("c")).alias("k")).where("k > 0")
    known = tf.join(held, "token").where(~((F.col("folds") == 1) & (F.col("only") == F.col("fold"))))
    length = known.groupBy(key, "fold", label).agg(F.sum("tf").alias("len"))
    gain = known.select(key, "fold", "token", "tf").join(seen, ["fold", "token"]).groupBy(key, "fold", "guess").agg(F.sum(F.col("tf") * F.log((F.col("k") + smoothing) / smoothing)).alias("gain"))
    asked = docs.select(key, "fold", label).join(length, [key, "fold", label], "left")
    scored = asked.join(frame, "fold").join(gain, [key, "fold", "guess"], "left")
    score = F.col("prior") + zero("gain") + zero("len") * (F.log(F.lit(smoothing)) - F.col("norm"))
    best = scored.groupBy(key, "fold", label).agg(F.min(F.struct((-F.round(score, 6)).alias("s"), "guess")).alias("b"))
    return best.select(F.col(key).alias(names[0]), "fold", F.col(label).alias(names[1]), F.col("b.guess").alias("guess"))
