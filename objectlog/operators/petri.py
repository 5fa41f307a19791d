"""Petri nets by inductive mining of directly-follows graphs (Leemans, Fahland and van der Aalst 2013), one net for each
object type. Graphs are counted in Spark; a graph has as many nodes as there are activities, and only graphs reach the
driver, where the recursion over cuts runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..log import ObjectLog
from . import traces

#: Activities of one object type that a graph may have on the driver.
MOST_ACTIVITIES = 5_000


@dataclass
class Tree:
    """A process tree: an activity, silence (None), or an operator over children."""

    op: str | None = None
    children: list[Tree] = field(default_factory=list)
    activity: str | None = None

    def __str__(self) -> str:
        return f"{self.op}({', '.join(map(str, self.children))})" if self.op else (self.activity or "tau")


@dataclass
class Net:
    """Places, transitions (label or None for silent) and arcs; from place `source` to place `sink`."""

    places: list[str] = field(default_factory=list)
    transitions: list[tuple[str, str | None]] = field(default_factory=list)
    arcs: list[tuple[str, str]] = field(default_factory=list)

    def place(self, name: str | None = None) -> str:
        self.places.append(name or f"p{len(self.places)}")
        return self.places[-1]

    def transition(self, label: str | None, before: Iterable[str], after: Iterable[str]) -> None:
        name = f"t{len(self.transitions)}"
        self.transitions.append((name, label))
        self.arcs += [(p, name) for p in before] + [(name, p) for p in after]


def _groups(nodes: set[str], linked) -> list[set[str]]:
    left, out = sorted(nodes), []
    while left:
        group, todo = set(), [left[0]]
        while todo:
            a = todo.pop()
            if a not in group:
                group.add(a)
                todo += [b for b in left if b not in group and linked(a, b)]
        out.append(group)
        left = [x for x in left if x not in group]
    return out


def _reach(nodes: set[str], edges: set[tuple[str, str]]) -> dict[str, set[str]]:
    ahead = {n: {b for a, b in edges if a == n} for n in nodes}
    out = {}
    for n in nodes:
        seen, todo = set(), list(ahead[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ahead[x]
        out[n] = seen
    return out


def mine(nodes: set[str], edges: set[tuple[str, str]], starts: set[str], ends: set[str], empty: bool = False) -> Tree:
    """A process tree of the graph; the flower of its activities if no cut fits. The tree has every trace of the graph but for
    those that skip or interleave parts which run side by side, of which edges tell nothing; token replay tells how many."""
    if empty:
        return Tree("xor", [Tree(), mine(nodes, edges, starts, ends)])
    if not nodes:
        return Tree()
    if len(nodes) == 1:
        (a,) = nodes
        return Tree("loop", [Tree(activity=a), Tree()]) if (a, a) in edges else Tree(activity=a)
    both = lambda g: {(a, b) for a, b in edges if a in g and b in g}
    parts = _groups(nodes, lambda a, b: (a, b) in edges or (b, a) in edges)
    if len(parts) > 1:
        return Tree("xor", [mine(p, both(p), starts & p, ends & p) for p in parts])
    reach = _reach(nodes, edges)
    parts = _groups(nodes, lambda a, b: (b in reach[a]) == (a in reach[b]))  # neither or both: not in sequence
    if len(parts) > 1:
        parts = sorted(parts, key=lambda p: sum(next(iter(q)) in reach[next(iter(p))] for q in parts if q is not p), reverse=True)
        children = []
        for i, p in enumerate(parts):
            before, after = set().union(*parts[:i], set()), set().union(*parts[i + 1 :], set())
            first = (starts & p) | {b for a, b in edges if a in before and b in p}
            last = (ends & p) | {a for a, b in edges if a in p and b in after}
            skipped = bool(starts & after) or bool(ends & before) or any(a in before and b in after for a, b in edges)
            children.append(mine(p, both(p), first, last, skipped))
        return Tree("seq", children)
    parts = _groups(nodes, lambda a, b: not ((a, b) in edges and (b, a) in edges))
    if len(parts) > 1 and all(p & starts and p & ends for p in parts):
        return Tree("and", [mine(p, both(p), starts & p, ends & p) for p in parts])
    body = starts | ends
    rest = nodes - body
    redo = _groups(rest, lambda a, b: (a, b) in edges or (b, a) in edges)
    good = [p for p in redo if all(b in p or b in starts for a, b in edges if a in p) and all(a in p or a in ends for a, b in edges if b in p)]
    for p in redo:
        if p not in good:
            body |= p
    if good:
        return Tree("loop", [mine(body, both(body), starts, ends)] + [mine(p, both(p), {b for a, b in edges if a in ends and b in p}, {a for a, b in edges if a in p and b in starts}) for p in good])
    return Tree("loop", [Tree(), *[Tree(activity=a) for a in sorted(nodes)]])


def net_of(tree: Tree) -> Net:
    """The tree as a sound workflow net."""
    net = Net()
    source, sink = net.place("source"), net.place("sink")

    def build(t: Tree, a: str, b: str) -> None:
        if t.op is None:
            net.transition(t.activity, [a], [b])
        elif t.op == "xor":
            for c in t.children:
                build(c, a, b)
        elif t.op == "seq":
            for i, c in enumerate(t.children):
                after = b if i == len(t.children) - 1 else net.place()
                build(c, a, after)
                a = after
        elif t.op == "and":
            ins, outs = [net.place() for _ in t.children], [net.place() for _ in t.children]
            net.transition(None, [a], ins)
            for c, i, o in zip(t.children, ins, outs, strict=True):
                build(c, i, o)
            net.transition(None, outs, [b])
        else:
            i, o = net.place(), net.place()
            net.transition(None, [a], [i])
            build(t.children[0], i, o)
            for c in t.children[1:]:
                build(c, o, i)
            net.transition(None, [o], [b])

    build(tree, source, sink)
    return net


def discover(log: ObjectLog, object_type: str | None = None, least: int = 1) -> dict[str, Net]:
    """A net for each object type (or the one asked for), of the edges that at least ``least`` pairs of events take, and of the
    first and last activities of as many."""
    edges = traces.dfg_by_type(log if object_type is None else log.of_type(object_type)).filter(F.col("frequency") >= least).select("otype", "src", "tgt")
    ends = log.e2o if object_type is None else log.e2o.filter(F.col("otype") == object_type)
    types = [r.otype for r in ends.select("otype").distinct().collect()]
    size = log.events.select("activity").distinct().count()
    if size > MOST_ACTIVITIES:
        raise ValueError(f"{size} activities; a net over more than {MOST_ACTIVITIES} says nothing, filter the log first")
    found = edges.collect()  # at most activities squared for each type
    out = {}
    for t in sorted(types):
        starts, last = ({r.activity for r in f(log, t).filter(F.col("frequency") >= least).collect()} for f in (traces.start_activities, traces.end_activities))
        own = {(r.src, r.tgt) for r in found if r.otype == t}
        nodes = {x for e in own for x in e} | starts | last
        out[t] = net_of(mine(nodes, own, starts, last))
    return out


def summary(nets: dict[str, Net]) -> dict:
    """Totals over all nets."""
    return {"nets_count": len(nets), "object_types": sorted(nets), "total_places": sum(len(n.places) for n in nets.values()), "total_transitions": sum(len(n.transitions) for n in nets.values()), "total_arcs": sum(len(n.arcs) for n in nets.values())}
