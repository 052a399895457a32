"""Interface to an external proof kernel, and a deterministic stand-in.

The stand-in proves nothing. It decides by hash whether a tactic applies, so
that what surrounds a kernel (grouping by theorem, prefix replay, statuses,
tracing) can be run and tested without one. It claims no parity with any kernel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Kernel(Protocol):
    def start(self, goal: str) -> str: ...

    def apply(self, state: str, tactic: str) -> str:
        """The next state; raises ValueError with the kernel's message."""


class StandInKernel:
    def __init__(self, failing: float = 0.5):
        self.failing = failing

    def start(self, goal: str) -> str:
        if not goal:
            raise ValueError("nothing to prove")
        return goal

    def apply(self, state: str, tactic: str) -> str:
        h = int(hashlib.md5(f"{state}|{tactic}".encode()).hexdigest()[:8], 16) / 2**32
        if not tactic or h < self.failing:
            raise ValueError(f"tactic '{tactic.split()[0]}' failed" if tactic.split() else "unexpected token: no tactic")
        return hashlib.md5(f"{state}|{tactic}".encode()).hexdigest()


VERIFIED = "error_id long, verification_status string, error_message string"


def verify(errors: DataFrame, kernel: Callable[[], Kernel]) -> DataFrame:
    """(error_id, verification_status, error_message): replays the prefix, then expects the faulty tactic to fail.

    errors: (error_id, goal, replay array of earlier tactics, error_tactic), and status where a row
    has been given one already and is not replayed.
    Every partition starts one kernel; a row's prefix is replayed in the row's task.
    """

    def run(frames):
        k = kernel()
        for frame in frames:
            out = []
            for row in frame.itertuples():
                if isinstance(given := getattr(row, "status", None), str):
                    out.append((row.error_id, given, ""))
                    continue
                status, message = "verified", ""
                try:
                    state = k.start(row.goal)
                except ValueError as e:
                    out.append((row.error_id, "goal_start_failed", str(e)))
                    continue
                for i, tactic in enumerate(row.replay if row.replay is not None else []):
                    try:
                        state = k.apply(state, tactic)
                    except ValueError as e:
                        status, message = f"replay_failed_at_step_{i}", str(e)
                        break
                if status == "verified":
                    try:
                        k.apply(state, row.error_tactic or "")
                        status = "error_tactic_succeeded"
                    except ValueError as e:
                        message = str(e)
                out.append((row.error_id, status, message))
            yield pd.DataFrame(out, columns=["error_id", "verification_status", "error_message"])

    return errors.mapInPandas(run, VERIFIED)


def trace(runs: DataFrame, kernel: Callable[[], Kernel]) -> DataFrame:
    """(run_id, step_index, tactic, state_before, state_after) of each run up to its first failure. runs: (run_id, goal, tactics)."""

    def run(frames):
        k = kernel()
        for frame in frames:
            out = []
            for row in frame.itertuples():
                try:
                    state = k.start(row.goal)
                    for i, tactic in enumerate(row.tactics):
                        after = k.apply(state, tactic)
                        out.append((row.run_id, i, tactic, state, after))
                        state = after
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=["run_id", "step_index", "tactic", "state_before", "state_after"])

    return runs.mapInPandas(run, "run_id long, step_index int, tactic string, state_before string, state_after string")
