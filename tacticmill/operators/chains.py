"""Building, compressing and filtering chains of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacticmill.functions.text import KEY_TACTICS, first_token, text


def full_chain(states: Column, tactics: Column) -> Column:
    """Traced steps if there are any, else steps with numbered stand-ins around each tactic."""
    made = F.transform(
        tactics,
        lambda t, i: F.struct(t.alias("tactic"), F.concat(F.lit("[state_"), i.cast("string"), F.lit("]")).alias("state_before"), F.concat(F.lit("[state_"), (i + 1).cast("string"), F.lit("]")).alias("state_after")),
    )
    return F.when(F.size(states) > 0, states).otherwise(made)


def with_key_indices(df: DataFrame, chain: str, out: str = "idx", ratio: int = 3) -> DataFrame:
    """df with the indices that the compressed chain keeps, ascending.

    Ends and landmark tactics are kept. More than the target max(n // ratio, 3)
    are thinned by a constant stride, ends put back; fewer are filled up with
    the other indices at a constant stride. Chains of up to three steps stay whole.
    Every intermediate array is a column, so no lambda computes it again.
    """
    n, marked, kept, rest = F.size(chain), F.col("_marked"), F.col("_kept"), F.col("_rest")
    every = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    target = F.greatest(F.floor(n / ratio).cast("int"), F.lit(3))
    stride = F.greatest(F.floor(F.size(marked) / target).cast("int"), F.lit(1))
    need = target - F.size(kept)
    step = F.greatest(F.floor(F.size(rest) / F.greatest(need, F.lit(1))).cast("int"), F.lit(1))
    df = df.withColumn("_heads", F.transform(chain, lambda s: first_token(s["tactic"])))
    df = df.withColumn("_marked", F.filter(every, lambda i: (i == 0) | (i == n - 1) | F.get("_heads", i).isin(*KEY_TACTICS)))
    df = df.withColumn("_stride", stride).withColumn("_kept", F.when(F.size(marked) > target, F.array_union(F.filter(marked, lambda v, i: i % F.col("_stride") == 0), F.array(F.lit(0), n - 1))).otherwise(marked))
    df = df.withColumn("_rest", F.array_except(every, kept)).withColumn("_stride", step)
    filled = F.array_union(kept, F.slice(F.filter(rest, lambda v, i: i % F.col("_stride") == 0), F.lit(1), F.greatest(need, F.lit(0))))
    whole = F.when(n == 0, F.array().cast("array<int>")).when(n <= 3, every).otherwise(F.array_sort(F.when(need > 0, filled).otherwise(kept)))
    return df.withColumn(out, whole).drop("_heads", "_marked", "_stride", "_kept", "_rest")


def compressed(df: DataFrame, chain: str, out: str, ratio: int = 3) -> DataFrame:
    """df with the compressed chain."""
    return with_key_indices(df, chain, "_idx", ratio).withColumn(out, F.transform("_idx", lambda i: F.get(chain, i))).drop("_idx")


def length_gate(chain: Column, least: int = 3, most: int = 50) -> tuple[Column, Column]:
    """(condition, cut chain): chains below the least length go, longer ones are cut."""
    return F.size(chain) >= least, F.slice(chain, 1, most)


def valid_step(state_before: Column, tactic: Column, state_after: Column) -> Column:
    """Not empty, no stand-in state, and changed unless the tactic may change nothing."""
    unchanged = (text(state_before) == text(state_after)) & ~tactic.isin("skip", "rfl")
    return (text(state_before) != "") & (text(tactic) != "") & ~state_before.startswith("[state_") & ~unchanged


def consecutive_states(tactics: Column, states: Column) -> Column:
    """(tactic, before, after) of a run; a missing last state means nothing is left."""
    return F.transform(tactics, lambda t, i: F.struct(t.alias("tactic"), F.get(states, i).alias("state_before"), F.coalesce(F.get(states, i + 1), F.lit("no goals")).alias("state_after")))
