"""Token replay: how well traces fit Petri nets, by the tokens that a replay has to add and the ones it leaves over.

Each distinct variant is replayed once and counted as often as it occurs, so work grows with variants, not with traces. A
net has as many nodes as there are activities; nets are sent to the tasks, variants stay where they are.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import ObjectLog
from . import traces
from .petri import Net

#: Markings that one search over silent transitions looks at before it gives up.
LOOKED_AT = 2_000


class Replay:
    """Replays of one net, from one token in ``source`` to one in ``sink``."""

    def __init__(self, net: Net):
        names = dict(net.transitions)
        self.inputs: dict[str, Counter] = {t: Counter() for t in names}
        self.outputs: dict[str, Counter] = {t: Counter() for t in names}
        for a, b in net.arcs:
            if a in names:
                self.outputs[a][b] += 1
            else:
                self.inputs[b][a] += 1
        self.by_label: dict[str, list[str]] = {}
        for t, label in net.transitions:
            if label is not None:
                self.by_label.setdefault(label, []).append(t)
        self.silent = [t for t, label in net.transitions if label is None]

    @staticmethod
    def _holds(marking: Counter, wanted: Counter) -> bool:
        return all(marking[p] >= n for p, n in wanted.items())

    def _silent_way(self, marking: Counter, goals: list[Counter], exact: bool = False) -> tuple[list[str], int] | None:
        """The fewest silent transitions after which a goal is held (or is all there is), and which goal it is."""
        todo, seen = deque([(marking, [])]), {frozenset(marking.items())}
        while todo and len(seen) < LOOKED_AT:
            now, way = todo.popleft()
            for k, goal in enumerate(goals):
                if self._holds(now, goal) and (not exact or sum(now.values()) == sum(goal.values())):
                    return way, k
            for t in self.silent:
                if self._holds(now, self.inputs[t]):
                    after = +(now - self.inputs[t] + self.outputs[t])
                    if (mark := frozenset(after.items())) not in seen:
                        seen.add(mark)
                        todo.append((after, [*way, t]))
        return None

    def __call__(self, trace: Iterable[str]) -> tuple[int, int, int, int]:
        """missing, remaining, consumed and produced tokens of a trace. An activity that the net does not have takes part in nothing
        but is a token missing and one remaining."""
        marking, missing, consumed, produced, foreign = Counter({"source": 1}), 0, 0, 1, 0

        def fire(t: str) -> None:
            nonlocal marking, missing, consumed, produced
            lacking = self.inputs[t] - marking
            missing += sum(lacking.values())
            marking = +(marking + lacking - self.inputs[t] + self.outputs[t])
            consumed += sum(self.inputs[t].values())
            produced += sum(self.outputs[t].values())

        for activity in trace:
            found = self.by_label.get(activity)
            if not found:
                foreign += 1
                continue
            way = self._silent_way(marking, [self.inputs[t] for t in found])
            # If nothing enables it, the transition that lacks least is forced.
            chosen = found[way[1]] if way else min(found, key=lambda t: (sum((self.inputs[t] - marking).values()), t))
            for t in way[0] if way else ():
                fire(t)
            fire(chosen)
        end = Counter({"sink": 1})
        way = self._silent_way(marking, [end], exact=True) or self._silent_way(marking, [end])
        for t in way[0] if way else ():
            fire(t)
        missing += 0 if marking["sink"] else 1
        remaining = sum((marking - end).values())
        return missing + foreign, remaining + foreign, consumed + 1 + foreign, produced + foreign


def fitness(missing: int, remaining: int, consumed: int, produced: int) -> float:
    """Half the share of consumed tokens that were there, half the share of produced ones that were used."""
    return 0.5 * (1 - missing / consumed) + 0.5 * (1 - remaining / produced)


def replayed(log: ObjectLog, nets: dict[str, Net]) -> DataFrame:
    """otype, sequence (activities), length, frequency, missing, remaining, consumed, produced, fitness: each distinct variant of each
    type that has a net. The token numbers are those of one trace. Traces of other types take no part."""
    replays = {t: Replay(n) for t, n in nets.items()}
    found = None
    for t in sorted(nets):  # declared types: as many as nets
        own = traces.variant_arrays(log, t).select(F.lit(t).alias("otype"), "sequence", "length", "frequency")
        found = own if found is None else found.unionByName(own)
    schema = "otype string, sequence array<string>, length long, frequency long, missing long, remaining long, consumed long, produced long, fitness double"
    if found is None:
        return log.spark.createDataFrame([], schema)

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            tokens = [replays[t](s) for t, s in zip(part["otype"], part["sequence"], strict=True)]
            numbers = pd.DataFrame(tokens, columns=["missing", "remaining", "consumed", "produced"], index=part.index)
            yield pd.concat([part, numbers, pd.Series([fitness(*x) for x in tokens], index=part.index, name="fitness", dtype=float)], axis=1)

    return found.mapInPandas(replay, schema)


def replay_fitness(log: ObjectLog, nets: dict[str, Net]) -> DataFrame:
    """otype, traces, fitting, missing, remaining, consumed, produced, fitness: over all traces of each type, each variant weighted by how often it
    occurs. ``fitting`` traces need no token and leave none."""
    n = F.col("frequency")
    total = replayed(log, nets).groupBy("otype").agg(
        F.sum(n).alias("traces"),
        F.sum(F.when((F.col("missing") == 0) & (F.col("remaining") == 0), n).otherwise(0)).alias("fitting"),
        *[F.sum(F.col(c) * n).alias(c) for c in ("missing", "remaining", "consumed", "produced")],
    )
    return total.withColumn("fitness", F.round(1 - F.col("missing") / F.col("consumed") / 2 - F.col("remaining") / F.col("produced") / 2, 6))
