"""Root-cause hypotheses scored from priors and likelihood ratios."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



@dataclass(frozen=True)
class DecisionPolicy:
    minimum_top_posterior: float = 0.70
    minimum_margin: float = 0.20
    minimum_distinct_evidence: int = 2
    maximum_normalized_entropy: float = 0.75
    likelihood_ratio_min: float = 0.05
    likelihood_ratio_max: float = 20.0


def posteriors(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Log score, softmax posterior and rank per investigation.

    Likelihood ratios are summed per hypothesis before the join.  The softmax is
    shifted by the investigation's maximum; its totals are plain aggregates.
    """
    key = ["investigation_id", "hypothesis_id"]
    summed = evidence.groupBy(*key).agg(
        F.sum(F.log("likelihood_ratio")).alias("_lr"),
        F.array_sort(F.collect_set(F.when(F.col("direction") == "support", F.col("evidence_record_id")))).alias("supporting_evidence_ids"),
        F.array_sort(F.collect_set(F.when(F.col("direction") == "contradict", F.col("evidence_record_id")))).alias("contradicting_evidence_ids"),
    )
    none = F.array().cast("array<string>")
    rows = hypotheses.join(summed, key, "left").withColumns({
        "log_evidence_score": F.log("prior_probability") + F.coalesce("_lr", F.lit(0.0)),
        "supporting_evidence_ids": F.coalesce("supporting_evidence_ids", none), "contradicting_evidence_ids": F.coalesce("contradicting_evidence_ids", none),
    }).drop("_lr")
    whole = W.partitionBy("investigation_id")
    rows = rows.withColumn("_w", F.exp(F.col("log_evidence_score") - F.max("log_evidence_score").over(whole)))
    rows = rows.withColumn("posterior_probability", F.col("_w") / F.sum("_w").over(whole)).drop("_w")
    # Equal evidence summed in another order differs in the last bits; ties go by id.
    order = whole.orderBy(F.round("posterior_probability", 12).desc(), "hypothesis_id")
    return rows.withColumn("rank", F.row_number().over(order))


def decide(scored: DataFrame, policy: DecisionPolicy = DecisionPolicy()) -> DataFrame:
    """Entropy, margin, confidence and the conclude-or-abstain decision."""
    p = F.col("posterior_probability")
    top = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    rows = scored.groupBy("investigation_id").agg(
        F.count(F.lit(1)).alias("_n"), (-F.sum(F.when(p > 0, p * F.log(p)))).alias("_h"), top("posterior_probability").alias("_top"),
        F.max(F.when(F.col("rank") == 2, p)).alias("_second"), top("hypothesis_id").alias("_winner"),
        F.max(F.when(F.col("rank") == 1, F.size(F.array_union("supporting_evidence_ids", "contradicting_evidence_ids")))).alias("distinct_evidence"),
    )
    rows = rows.withColumns({
        "normalized_entropy": F.when(F.col("_n") > 1, F.col("_h") / F.log(F.col("_n").cast("double"))).otherwise(0.0),
        "posterior_margin": F.col("_top") - F.coalesce("_second", F.lit(0.0)),
    })
    # As for ranks: a value on its limit must not be decided by the order of summation.
    exact = lambda c: F.round(c, 12)
    ok = ((exact("_top") >= policy.minimum_top_posterior) & (exact("posterior_margin") >= policy.minimum_margin)
          & (F.col("distinct_evidence") >= policy.minimum_distinct_evidence) & (exact("normalized_entropy") <= policy.maximum_normalized_entropy))
    return rows.select(
        "investigation_id", "normalized_entropy", "posterior_margin", "distinct_evidence",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_top") * (1.0 - F.col("normalized_entropy")))).alias("confidence"),
        F.when(ok, "concluded").otherwise("abstained").alias("status"), F.when(ok, F.col("_winner")).alias("selected_hypothesis_id"),
    )


def proposal_issues(hypotheses: DataFrame, evidence: DataFrame, observed: DataFrame, policy: DecisionPolicy = DecisionPolicy()) -> DataFrame:
    """Priors not summing to 1, bad ratios or directions, unobserved or repeated citations."""
    lr = F.col("likelihood_ratio")
    key = F.concat_ws("/", "investigation_id", "hypothesis_id", "evidence_record_id")
    wrong_way = ((F.col("direction") == "support") & (lr <= 1)) | ((F.col("direction") == "contradict") & (lr >= 1))
    parts = [
        hypotheses.groupBy("investigation_id").agg(F.sum("prior_probability").alias("s")).where(F.abs(F.col("s") - 1.0) > 1e-6).select(F.lit("prior.sum").alias("code"), F.col("investigation_id").alias("subject")),
        evidence.where((lr < policy.likelihood_ratio_min) | (lr > policy.likelihood_ratio_max)).select(F.lit("ratio.bounds").alias("code"), key.alias("subject")),
        evidence.where(wrong_way).select(F.lit("ratio.direction").alias("code"), key.alias("subject")),
        evidence.join(observed.select("evidence_record_id").distinct(), "evidence_record_id", "left_anti").select(F.lit("evidence.unobserved").alias("code"), key.alias("subject")),
        evidence.groupBy("investigation_id", "hypothesis_id", "evidence_record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("evidence.repeated").alias("code"), key.alias("subject")),
    ]
    return reduce(DataFrame.unionByName, parts)


def report_metrics(scored: DataFrame, decisions: DataFrame, answers: DataFrame, observed: DataFrame) -> DataFrame:
    """Set-level accuracy, Brier, abstention and citation quality."""
    truth = answers.select("investigation_id", "true_hypothesis_id", "should_abstain")
    rows = scored.join(truth, "investigation_id")
    hit = F.col("hypothesis_id") == F.col("true_hypothesis_id")
    per = rows.where("true_hypothesis_id IS NOT NULL").groupBy("investigation_id").agg(
        F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(0)).alias("place"),
        (F.sum(F.pow(F.col("posterior_probability") - hit.cast("double"), 2)) + F.when(F.max(hit.cast("int")) == 0, 1.0).otherwise(0.0)).alias("brier"),
    )
    quality = per.agg(F.coalesce(F.avg((F.col("place") == 1).cast("double")), F.lit(0.0)).alias("top1_accuracy"),
                      F.coalesce(F.avg(F.col("place").between(1, 3).cast("double")), F.lit(0.0)).alias("top3_accuracy"), F.coalesce(F.avg("brier"), F.lit(0.0)).alias("mean_brier_score"))
    abstain = decisions.join(truth, "investigation_id").agg(F.count(F.lit(1)).alias("case_count"), F.avg(((F.col("status") == "abstained") == F.col("should_abstain")).cast("double")).alias("abstention_accuracy"))
    cited = scored.withColumn("_refs", F.array_union("supporting_evidence_ids", "contradicting_evidence_ids"))
    coverage = cited.agg(F.avg((F.size("_refs") > 0).cast("double")).alias("evidence_citation_coverage"), F.sum(F.size("_refs")).alias("_cited"))
    refs = cited.select("investigation_id", F.explode("_refs").alias("evidence_record_id"))
    foreign = refs.join(observed.select("investigation_id", "evidence_record_id").distinct(), ["investigation_id", "evidence_record_id"], "left_anti").agg(F.count(F.lit(1)).alias("_foreign"))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [quality, abstain, coverage, foreign])
    row = stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))
    return row.withColumn("unsupported_evidence_rate", F.col("_foreign") / F.greatest("_cited", F.lit(1))).drop("_foreign", "_cited")
