"""Answers as Markdown and graphs as DOT text."""

from __future__ import annotations

from collections.abc import Iterable

from ..operators.petri import Net


def table(rows: Iterable[dict], columns: list[str] | None = None, most: int = 20) -> str:
    """Rows as a Markdown table, at most ``most`` of them, with a note on the rest."""
    rows = list(rows)
    if not rows:
        return "_nothing found_"
    columns = columns or list(rows[0])
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"_{len(rows) - most} more_"] if len(rows) > most else []))


def report(title: str, *parts: str) -> str:
    return "\n\n".join([f"## {title}", *parts])


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dfg_dot(edges: Iterable[tuple[str, str, int]], starts: Iterable[str] = ()) -> str:
    """A directly-follows graph: an edge is as thick as it is frequent beside the most frequent one, start activities have a
    double line."""
    edges, starts = list(edges), set(starts)
    most = max((n for *_, n in edges), default=1)
    lines = ["digraph follows {", "  graph [rankdir=TB]"]
    for name in sorted({x for a, b, _ in edges for x in (a, b)} | starts):
        lines.append(f"  {_quoted(name)} [shape=ellipse, peripheries={2 if name in starts else 1}]")
    for a, b, n in edges:
        lines.append(f"  {_quoted(a)} -> {_quoted(b)} [label={_quoted(str(n))}, penwidth={0.5 + 3.5 * n / most:.2f}]")
    return "\n".join([*lines, "}"])


def petri_dot(net: Net) -> str:
    """A net with its own places, transitions and arcs; silent transitions are black."""
    body = [f"  {_quoted(p)} [shape=circle, label=\"\"];" for p in net.places]
    body += [f"  {t} [shape=box, label={_quoted(label)}];" if label else f"  {t} [shape=box, style=filled, fillcolor=black, label=\"\"];" for t, label in net.transitions]
    return "\n".join(["digraph {", "  rankdir=LR;", *body, *[f"  {_quoted(a)} -> {_quoted(b)};" for a, b in net.arcs], "}"])


def summary_svg(events: int, objects: int) -> str:
    """Two counters side by side."""
    box = lambda x, n, text: f'<g transform="translate({x},10)"><rect width="140" height="60" rx="8" fill="none" stroke="currentColor"/><text x="70" y="28" text-anchor="middle">{n}</text><text x="70" y="48" text-anchor="middle">{text}</text></g>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="310" height="80">{box(10, events, "events")}{box(160, objects, "objects")}</svg>'
