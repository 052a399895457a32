"""Best-first tree search, repair and self-play around an external kernel, one theorem to a group."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacticmill.functions.text import route_of
from tacticmill.operators.sampling import sample
from tacticmill.sources.kernel import Kernel

FOUND = "theorem string, solved boolean, nodes int, tactics string"


@dataclass
class _Node:
    state: str
    parent: _Node | None = None
    tactic: str = ""
    visits: int = 0
    value: float = 0.0
    children: list[_Node] = field(default_factory=list)
    tried: int = 0
    failed: int = 0

    def bound(self, c: float) -> float:
        if not self.visits:
            return math.inf
        above = max(self.parent.visits, 1) if self.parent else 1
        return self.value / self.visits + c * math.sqrt(math.log(above) / self.visits)

    def path(self) -> list[str]:
        return [*self.parent.path(), self.tactic] if self.parent else []


def search_one(goal: str, tactics: list[str], kernel: Kernel, solved: Callable[[str], bool], budget: int = 64, c: float = 1.414) -> tuple[bool, int, list[str]]:
    """(solved, nodes, tactics): select by upper bound, expand by the next untried tactic, add the reward to all ancestors."""
    try:
        root = _Node(kernel.start(goal))
    except ValueError:
        return False, 0, []
    nodes, seen = 1, {root.state}
    for _ in range(budget):
        node = root
        while node.tried >= len(tactics) and node.children:
            node = max(node.children, key=lambda n: n.bound(c))
        if node.tried >= len(tactics):
            break
        tactic = tactics[node.tried]
        node.tried += 1
        reward = -0.1
        try:
            state = kernel.apply(node.state, tactic)
            if state not in seen:
                seen.add(state)
                child = _Node(state, node, tactic)
                node.children.append(child)
                nodes += 1
                if solved(state):
                    return True, nodes, child.path()
                node, reward = child, 0.3
        except ValueError:
            pass
        while node:
            node.visits += 1
            node.value += reward
            node = node.parent
    return False, nodes, []


def tree_search(theorems: DataFrame, kernel: Callable[[], Kernel], solved: Callable[[str], bool], budget: int = 64) -> DataFrame:
    """theorems: (theorem, goal, tactics array), one row each; the search of a theorem is one row's work."""

    def run(frames):
        k = kernel()
        for frame in frames:
            rows = [(r.theorem, *search_one(r.goal, list(r.tactics), k, solved, budget)) for r in frame.itertuples()]
            yield pd.DataFrame([(t, s, n, ";".join(path)) for t, s, n, path in rows], columns=["theorem", "solved", "nodes", "tactics"])

    return theorems.mapInPandas(run, FOUND)


def repair_one(state: str, tactic: str, repairs: Callable[[str, str], list[str]], kernel: Kernel, attempts: int = 3, rounds: int = 2, above: str | None = None) -> tuple[bool, str, str, int]:
    """(success, route, tactic, attempts) for a tactic that fails in a state.

    The class of the kernel's message decides the route: ETR tries other tactics in the state, ESR
    gives the state up and tries them in the one ``above`` it. ETR turns to ESR when its attempts
    are used up or a further message or the number of failures calls for it.
    """
    n = failures = 0
    failing, route = tactic, "ETR"
    try:
        kernel.apply(state, tactic)
        return True, "none", tactic, 0
    except ValueError as e:
        failures += 1
        route = route_of(str(e), failures)[1]
    for _ in range(rounds):
        here = state if route == "ETR" or above is None else above
        turned = False
        for candidate in repairs(failing, route)[:attempts]:
            n += 1
            try:
                kernel.apply(here, candidate)
                return True, route, candidate, n
            except ValueError as e:
                failures += 1
                failing = candidate
                turned = route == "ETR" and route_of(str(e), failures)[1] == "ESR"
            if turned:
                break
        if route == "ESR":
            break
        route = "ESR"
    return False, "ESR", "", n


def two_level_search(goal: str, tactics: list[str], kernel: Kernel, solved: Callable[[str], bool], repairs: Callable[[str, str], list[str]], outer: int = 16, inner: int = 8, c: float = 1.414) -> tuple[bool, int, list[str]]:
    """(solved, nodes, tactics): an outer tree of states, and an inner search with its own budget at each state it selects.

    The outer level selects a state by upper bound. The inner one tries the tactics not tried there yet,
    repairs the failing ones, and hands the new states back as children; it ends at the inner budget, with a solution or with nothing left to try.
    The best reward of the inner search goes to the state and to all above it. A message or a number of failures
    that calls for ESR closes the state, so that the outer level goes back.
    """
    try:
        root = _Node(kernel.start(goal))
    except ValueError:
        return False, 0, []
    nodes, seen = 1, {root.state}
    for _ in range(outer):
        node = root
        while node.tried >= len(tactics) and node.children:
            node = max(node.children, key=lambda n: n.bound(c))
        if node.tried >= len(tactics):
            break
        best = -0.1
        for _ in range(inner):
            if node.tried >= len(tactics):
                break
            tactic = tactics[node.tried]
            node.tried += 1
            here = node
            try:
                state = kernel.apply(node.state, tactic)
            except ValueError as e:
                node.failed += 1
                if route_of(str(e), node.failed)[1] == "ESR":
                    node.tried = len(tactics)
                above = node.parent or node
                won, route, tactic, _ = repair_one(node.state, tactic, repairs, kernel, above=above.state)
                if not won:
                    continue
                here = above if route == "ESR" else node
                state = kernel.apply(here.state, tactic)
            if state in seen:
                continue
            seen.add(state)
            child = _Node(state, here, tactic)
            here.children.append(child)
            nodes += 1
            best = max(best, 0.3)
            if solved(state):
                return True, nodes, child.path()
        while node:
            node.visits += 1
            node.value += best
            node = node.parent
    return False, nodes, []


def state_search(theorems: DataFrame, kernel: Callable[[], Kernel], solved: Callable[[str], bool], repairs: Callable[[str, str], list[str]], outer: int = 16, inner: int = 8) -> DataFrame:
    """theorems: (theorem, goal, tactics array), one row each; the two-level search of a theorem is one row's work."""

    def run(frames):
        k = kernel()
        for frame in frames:
            rows = [(r.theorem, *two_level_search(r.goal, list(r.tactics), k, solved, repairs, outer, inner)) for r in frame.itertuples()]
            yield pd.DataFrame([(t, s, n, ";".join(path)) for t, s, n, path in rows], columns=["theorem", "solved", "nodes", "tactics"])

    return theorems.mapInPandas(run, FOUND)


def repair(errors: DataFrame, repairs: Callable[[str, str], list[str]], kernel: Callable[[], Kernel]) -> DataFrame:
    """errors: (error_id, state, error_tactic) to (error_id, success, route, repaired_tactic, attempts)."""

    def run(frames):
        k = kernel()
        for frame in frames:
            yield pd.DataFrame([(r.error_id, *repair_one(r.state, r.error_tactic or "", repairs, k)) for r in frame.itertuples()], columns=["error_id", "success", "route", "repaired_tactic", "attempts"])

    return errors.mapInPandas(run, "error_id long, success boolean, route string, repaired_tactic string, attempts int")


def self_play(theorems: DataFrame, base: DataFrame, search: Callable[[DataFrame], DataFrame], rounds: int = 2, batch: int = 64, base_share: float = 0.5, seed: int = 42) -> DataFrame:
    """(theorem, tactics, origin): each round samples theorems not solved yet, searches them and keeps the solved; the base is mixed in at its share."""
    from tacticmill.session import cut

    won = None
    for i in range(rounds):
        open_ = theorems if won is None else theorems.join(won.select("theorem"), "theorem", "left_anti")
        found = cut(search(sample(open_, "theorem", batch, seed + i)).where("solved").select("theorem", "tactics"), "self-play")
        won = found if won is None else won.union(found)
    wanted = int(won.count() * base_share / (1 - base_share))
    return won.withColumn("origin", F.lit("search")).unionByName(sample(base.select("theorem", "tactics"), "theorem", wanted, seed).withColumn("origin", F.lit("base")))
