"""The dataset pipeline end to end: chains to steps, faults, union, dedup, group split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacticmill.functions.text import fingerprint, text
from tacticmill.operators.augment import inject
from tacticmill.operators.chains import valid_step, with_key_indices
from tacticmill.operators.filters import usable_proof
from tacticmill.operators.windows import keep_first, ratio_split


def flat_steps(chains: DataFrame) -> DataFrame:
    """Steps of the compressed chains with their index in the compressed and in the full chain."""
    good = chains.where(usable_proof(F.size("full_cos_chain"), F.col("full_cos_chain.tactic")) & (F.size("full_cos_chain") >= 3))
    flat = with_key_indices(good, "full_cos_chain").select("cos_id", "theorem_full_name", "full_cos_chain", F.posexplode(F.slice("idx", 1, 50)).alias("step_index", "full_index"))
    s = F.get("full_cos_chain", F.col("full_index"))
    rows = flat.select("cos_id", "theorem_full_name", "step_index", "full_index", s["tactic"].alias("tactic"), s["state_before"].alias("state_before"), s["state_after"].alias("state_after"))
    return rows.where(valid_step(F.col("state_before"), F.col("tactic"), F.col("state_after")))


def dataset(chains: DataFrame, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """(kind, cos_id, step_index, tactic, error_type, error_tactic, split): sound steps and their faults, distinct, whole theorems to a split."""
    steps = flat_steps(chains)
    sound = steps.select(F.lit("step").alias("kind"), "cos_id", "theorem_full_name", "step_index", "tactic")
    faults = inject(steps, ["cos_id", "step_index"], "tactic", "step_index").join(steps.select("cos_id", "step_index", "theorem_full_name"), ["cos_id", "step_index"])
    rows = sound.unionByName(faults.select(F.lit("error").alias("kind"), "cos_id", "theorem_full_name", "step_index", "tactic", "error_type", "error_tactic"), allowMissingColumns=True)
    rows = rows.withColumn("_key", fingerprint(F.col("kind"), F.col("theorem_full_name"), F.col("step_index").cast("string"), F.col("tactic"), F.col("error_tactic")))
    first = keep_first(rows, ["_key"], ["cos_id", text(F.col("error_type"))]).drop("_key")
    parts = ratio_split(steps, "theorem_full_name", ratios, seed)
    return first.join(parts, "theorem_full_name").select("kind", "cos_id", "step_index", "tactic", "error_type", "error_tactic", "split")
