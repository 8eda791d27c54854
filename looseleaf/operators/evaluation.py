"""Retrieval evaluation: recall of expected sections, means by mode, wins and ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def section_recall(questions: DataFrame, evidence: DataFrame, modes: list[str]) -> DataFrame:
    """(qid, mode, hops, found, recall) from questions (qid, hops, expects) and evidence (qid, mode, section).

    found joins the expected sections that were found, in order; a question that expects nothing has recall null. A mode
    in which nothing was found for a question still has its row.
    """
    got = evidence.where("section is not null").groupBy("qid", "mode").agg(F.collect_set("section").alias("got"))
    x = questions.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).join(got, ["qid", "mode"], "left")
    hit = F.array_sort(F.array_intersect(F.array_distinct("expects"), F.coalesce("got", F.array().cast("array<string>"))))
    n = F.size(F.array_distinct("expects"))
    return x.select("qid", "mode", "hops", F.array_join(hit, "; ").alias("found"), F.when(n > 0, F.round(F.size(hit) / n, 6)).alias("recall"))


def verdict(recalls: DataFrame) -> DataFrame:
    """(mode, questions, mean, mean_multi): means of recall over all questions and over those of several hops."""
    return recalls.where("recall is not null").groupBy("mode").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("recall"), 6).alias("mean"), F.round(F.avg(F.when(F.col("hops") > 1, F.col("recall"))), 6).alias("mean_multi"))


def wins(recalls: DataFrame, a: str, b: str) -> DataFrame:
    """(outcome, n): for how many questions mode a or b recalled more, or both as much."""
    x = recalls.where("recall is not null").groupBy("qid").agg(F.max(F.when(F.col("mode") == a, F.col("recall"))).alias("a"), F.max(F.when(F.col("mode") == b, F.col("recall"))).alias("b"))
    outcome = F.when(F.col("a") > F.col("b"), a).when(F.col("a") < F.col("b"), b).when(F.col("a") == F.col("b"), "tie")
    return x.select(outcome.alias("outcome")).where("outcome is not null").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
