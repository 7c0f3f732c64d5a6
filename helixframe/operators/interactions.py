"""Ligand-receptor interactions: activities of ligands and the order of sender-ligand-receiver-receptor rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.ranks import average_rank, quantile_scaled

#: The smallest normal double: what p-values of zero count as.
TINY = 2.2250738585072014e-308
ONE_CONDITION = {"de_ligand": 1.0, "de_receptor": 1.0, "activity_scaled": 1.0, "exprs_ligand": 1.0, "exprs_receptor": 1.0, "ligand_condition_specificity": 0.0, "receptor_condition_specificity": 0.0}
CASE_CONTROL = {k: 1.0 for k in ONE_CONDITION}


def _signed(p: str, lfc: str) -> Column:
    return -F.log10(F.greatest(F.col(p), F.lit(TINY))) * F.signum(lfc)


def _rank_scaled(rows: DataFrame, value: str, as_: str) -> DataFrame:
    """Mean rank over the largest one."""
    r = rows.withColumn("r__", average_rank([], F.col(value)))
    return r.withColumn(as_, F.col("r__") / F.max("r__").over(Window.partitionBy(F.lit(0)))).drop("r__")


def prioritise_interactions(celltype_de: DataFrame, expression: DataFrame, activities: DataFrame, network: DataFrame, senders: list[str], receivers: list[str], condition_de: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(sender, ligand, receiver, receptor, the scaled terms, prioritisation_score, prioritisation_rank).

    celltype_de has (cluster_id, gene, lfc, pval), expression (cluster_id, gene, avg_expr), activities (ligand,
    aupr_corrected), network (ligand, receptor), condition_de (gene, lfc, pval). Terms with weight 0 are left out; pairs
    that an active term does not know are left out. All frames are gene tables, small beside the cells."""
    w = weights or (CASE_CONTROL if condition_de is not None else ONE_CONDITION)
    network = network.select("ligand", "receptor").distinct()
    ligands, receptors = network.select(F.col("ligand").alias("gene")).distinct(), network.select(F.col("receptor").alias("gene")).distinct()

    def de(side: str, gene: str, names: list[str], known: DataFrame) -> DataFrame:
        d = celltype_de.filter(F.col("cluster_id").isin(names)).join(known, "gene", "left_semi").select(F.col("cluster_id").alias(side), F.col("gene").alias(gene), _signed("pval", "lfc").alias("adapted"))
        return _rank_scaled(d, "adapted", f"scaled_de_{gene}").drop("adapted")

    def expr(side: str, gene: str, names: list[str], known: DataFrame) -> DataFrame:
        d = expression.filter(F.col("cluster_id").isin(names)).join(known, "gene", "left_semi").select(F.col("cluster_id").alias(side), F.col("gene").alias(gene), "avg_expr")
        return d.select(side, gene, quantile_scaled(F.col("avg_expr"), [F.col(gene)], 0.05).alias(f"scaled_expr_{gene}"))

    def cond(gene: str, known: DataFrame) -> DataFrame:
        d = condition_de.join(known, "gene", "left_semi").select(F.col("gene").alias(gene), _signed("pval", "lfc").alias("adapted"))
        return _rank_scaled(d, "adapted", f"scaled_condition_{gene}").drop("adapted")

    pairs = network.withColumn("sender", F.explode(F.array(*map(F.lit, senders)))).withColumn("receiver", F.explode(F.array(*map(F.lit, receivers))))
    terms: list[tuple[str, float]] = []

    def joined(out: DataFrame, frame: DataFrame, on: list[str], name: str, weight: float) -> DataFrame:
        terms.append((name, weight))
        return out.join(frame, on)

    if w["de_ligand"] > 0:
        pairs = joined(pairs, de("sender", "ligand", senders, ligands), ["sender", "ligand"], "scaled_de_ligand", 0.5 * w["de_ligand"])
    if w["de_receptor"] > 0:
        pairs = joined(pairs, de("receiver", "receptor", receivers, receptors), ["receiver", "receptor"], "scaled_de_receptor", 0.5 * w["de_receptor"])
    if w["exprs_ligand"] > 0:
        pairs = joined(pairs, expr("sender", "ligand", senders, ligands), ["sender", "ligand"], "scaled_expr_ligand", 0.5 * w["exprs_ligand"])
    if w["exprs_receptor"] > 0:
        pairs = joined(pairs, expr("receiver", "receptor", receivers, receptors), ["receiver", "receptor"], "scaled_expr_receptor", 0.5 * w["exprs_receptor"])
    if w["activity_scaled"] > 0:
        la = activities.select("ligand", quantile_scaled(F.col("aupr_corrected"), [], 0.01).alias("scaled_activity"))
        pairs = joined(pairs, la, ["ligand"], "scaled_activity", w["activity_scaled"])
    if condition_de is not None and w["ligand_condition_specificity"] > 0:
        pairs = joined(pairs, cond("ligand", ligands), ["ligand"], "scaled_condition_ligand", w["ligand_condition_specificity"])
    if condition_de is not None and w["receptor_condition_specificity"] > 0:
        pairs = joined(pairs, cond("receptor", receptors), ["receptor"], "scaled_condition_receptor", w["receptor_condition_specificity"])
    total = sum(v * (0.5 if k[:3] in ("de_", "exp") else 1.0) for k, v in w.items())
    score = sum((F.col(n) * v for n, v in terms), F.lit(0.0)) / total
    out = pairs.withColumn("prioritisation_score", score)
    return out.withColumn("prioritisation_rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("prioritisation_score", 9)))))


def ligand_activity(influence: DataFrame, targets: DataFrame) -> DataFrame:
    """(ligand, auroc, aupr_corrected) of influence (ligand, gene, score) for the genes of targets (gene): area under the
    curves, the precision one less the share of targets. Ties in score go to the smaller gene."""
    hit = F.col("hit").isNotNull()
    r = influence.join(targets.select("gene", F.lit(1).alias("hit")).distinct(), "gene", "left")
    w = Window.partitionBy("ligand").orderBy(F.desc("score"), "gene")
    r = r.withColumn("rank", F.row_number().over(w)).withColumn("hits", F.count("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pos, n = F.count("hit"), F.count(F.lit(1))
    g = r.groupBy("ligand").agg(pos.alias("pos"), n.alias("n"), F.sum(F.when(hit, F.col("rank"))).alias("ranks"), (F.sum(F.when(hit, F.col("hits") / F.col("rank")))).alias("ap"))
    p, m = F.col("pos").cast("double"), F.col("n").cast("double")
    auroc = (p * m - F.col("ranks") - p * (p - 1) / 2) / (p * (m - p))  # non-targets behind each target
    return g.filter("pos > 0 and pos < n").select("ligand", auroc.alias("auroc"), (F.col("ap") / p - p / m).alias("aupr_corrected"))



def ligand_influence(seeds: DataFrame, signalling: DataFrame, regulation: DataFrame, damping: float = 0.5, cutoff: float = 0.9) -> DataFrame:
    """(ligand, target, influence): each ligand (ligand, node) diffuses over the signalling network (src, dst, weight); of
    its scores those above their `cutoff` quantile go on along the regulation network (src, dst, weight) to targets."""
    from helixframe.operators.graphs import personalised_page_rank

    p = personalised_page_rank(signalling, seeds.select("ligand", "node", F.lit(1.0).alias("score")), damping, by=("ligand",))
    high = p.groupBy("ligand").agg(F.percentile("score", F.lit(cutoff)).alias("cut"))
    kept = p.join(high, "ligand").filter("score >= cut")
    return kept.join(regulation, F.col("node") == F.col("src")).groupBy("ligand", F.col("dst").alias("target")).agg(F.sum(F.col("score") * F.col("weight")).alias("influence"))
