"""The tool surface: named operations with plain arguments and answers, for a front end to call."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import render
from ..log import ObjectLog
from ..operators import filters, petri, search, setops, stats, traces
from ..sources.staging import folder
from .cursor import Cursors, Models

#: Models of all logs of this process.
MODELS = Models()


class Tools:
    """Operations over one log. Those that find events keep them as a cursor and answer with its name; others answer with
    a dict of rows and a Markdown summary. A mistake in the arguments is an answer with ``error``."""

    def __init__(self, log: ObjectLog, strategy: str | None = None):
        self.log, self.cursors = log, Cursors()
        self._strategy, self._index = strategy, None

    def call(self, tool: str, **arguments: Any) -> dict:
        """Run a tool by name."""
        if tool not in TOOLS:
            return {"error": f"no tool {tool!r}", "tools": sorted(TOOLS)}
        try:
            return TOOLS[tool](self, **arguments)
        except (ValueError, KeyError, TypeError) as e:
            return {"error": str(e.args[0] if e.args else e)}

    def _keep(self, tool: str, rows: DataFrame) -> dict:
        return {"cursor_id": self.cursors.put(tool, rows)}

    def _refs(self, events: DataFrame) -> DataFrame:
        return filters.references(self.log, events)

    # Filters

    def trace_object_lifecycle(self, object_id: str, input_cursor_id: str | None = None) -> dict:
        """Events of one object in order."""
        rows = filters.refs_with_object(self.cursors.get(input_cursor_id), object_id) if input_cursor_id else self._refs(filters.lifecycle(self.log, object_id, strict=True))
        return self._keep("trace_object_lifecycle", rows.orderBy("timestamp", "event_id"))

    def query_events_by_timerange(self, start: str, end: str, input_cursor_id: str | None = None) -> dict:
        """Events between two times, both included; without an offset a time is UTC."""
        if input_cursor_id:
            return self._keep("query_events_by_timerange", self.cursors.get(input_cursor_id).filter(F.col("timestamp").between(filters.moment(start), filters.moment(end))))
        return self._keep("query_events_by_timerange", self._refs(filters.between(self.log, start, end)))

    def filter_by_event_type(self, event_type: str, input_cursor_id: str | None = None) -> dict:
        """Events of an activity."""
        if input_cursor_id:
            return self._keep("filter_by_event_type", self.cursors.get(input_cursor_id).filter(F.col("activity") == event_type))
        return self._keep("filter_by_event_type", self._refs(filters.by_activity(self.log, event_type, strict=True)))

    def filter_by_object_type(self, object_type: str, input_cursor_id: str | None = None) -> dict:
        """Events with an object of a type."""
        if input_cursor_id:
            return self._keep("filter_by_object_type", filters.refs_with_type(self.cursors.get(input_cursor_id), object_type))
        return self._keep("filter_by_object_type", self._refs(filters.by_object_type(self.log, object_type, strict=True)))

    # Statistics and structure

    def get_statistics_by_object_type(self) -> dict:
        """Objects by type."""
        return self._answer("Objects by type", stats.by_object_type(self.log).orderBy("otype"))

    def detect_anomalies(self) -> dict:
        """Objects without events, events without objects."""
        return self._keep("detect_anomalies", stats.anomalies(self.log))

    def find_orphaned_objects(self) -> dict:
        """Objects without events."""
        return self._keep("find_orphaned_objects", stats.orphaned_objects(self.log).select(F.col("oid").alias("object_id"), F.lit("orphaned").alias("status")))

    def search_ocel(self, query: str, top_k: int = 5, chunk_types: list[str] | None = None, mode: str | None = "bm25") -> dict:
        """Search in types, events and objects; ``chunk_types`` names chunk types or the groups schema and data, a null mode
        the strategy by size."""
        return self._answer("Search", self._indexed().search(query, top_k, chunk_types, mode))

    def get_search_info(self) -> dict:
        """The index's strategy, size and chunks."""
        return self._indexed().info()

    def _indexed(self) -> search.Index:
        """The index of the log's chunks, written at the first search."""
        if self._index is None:
            self._index = search.Index.build(search.chunks(self.log), folder(self.log.spark, "index"), force=self._strategy)
        return self._index

    # Process mining

    def discover_dfg(self, object_type: str | None = None, include_visualization: bool = False) -> dict:
        """Which activity follows which, and which come first."""
        edges = [r.asDict() for r in traces.dfg(self.log, object_type).orderBy(F.desc("frequency"), "src", "tgt").collect()]
        starts = [r.asDict() for r in traces.start_activities(self.log, object_type).orderBy(F.desc("frequency"), "activity").collect()]
        out = {"edges": edges, "start_activities": starts, "summary": render.report("Directly-follows graph", render.table(edges, most=5), render.table(starts, most=5))}
        if include_visualization:
            out["dot"] = render.dfg_dot([(e["src"], e["tgt"], e["frequency"]) for e in edges], [s["activity"] for s in starts])
        return out

    def discover_petri_net(self, object_type: str | None = None, include_visualization: bool = False) -> dict:
        """A Petri net for each object type; kept for this log."""
        nets = MODELS.get(self.log, f"petri:{object_type}", lambda: petri.discover(self.log, object_type))
        out = petri.summary(nets) | {"summary": render.report("Petri nets", render.table([{"object_type": t, "places": len(n.places), "transitions": len(n.transitions), "arcs": len(n.arcs)} for t, n in nets.items()]))}
        return out | ({"dot": {t: render.petri_dot(n) for t, n in nets.items()}} if include_visualization else {})

    def get_process_variants(self, object_type: str | None = None, limit: int = 10) -> dict:
        """The most frequent sequences of activities."""
        return self._keep("get_process_variants", traces.variants(self.log, object_type, limit))

    def get_activity_frequency(self, limit: int = 10) -> dict:
        """The most frequent activities with sample events."""
        return self._keep("get_activity_frequency", stats.activity_frequency(self.log, limit))

    def get_performance_metrics(self, object_type: str | None = None) -> dict:
        """Seconds between consecutive activities."""
        return self._answer("Performance", traces.performance(self.log, object_type).orderBy(F.desc("count"), "src", "tgt"))

    def detect_bottlenecks(self, object_type: str | None = None, threshold_percentile: float = 75) -> dict:
        """Transitions whose mean time reaches a percentile of all."""
        return self._keep("detect_bottlenecks", traces.bottlenecks(self.log, object_type, threshold_percentile))

    def check_conformance(self, object_type: str | None = None, min_frequency: int = 1) -> dict:
        """Share of traces that stay on edges of at least a frequency, with the first deviations."""
        model = traces.dfg(self.log, object_type).filter(F.col("frequency") >= min_frequency)
        first = traces.deviations(self.log, model, object_type).orderBy("otype", "oid").limit(20)
        return self._answer("Conformance", traces.conformance(self.log, model, object_type)) | {"deviations": [r.asDict() for r in first.collect()]}

    def analyze_object_interactions(self) -> dict:
        """Pairs of object types that share events."""
        return self._keep("analyze_object_interactions", traces.top_interactions(self.log))

    def get_available_resource_attributes(self) -> dict:
        """Event attributes that may name who did it."""
        return self._answer("Resource attributes", traces.resource_attributes(self.log).orderBy("attribute"))

    def discover_social_network(self, resource_attribute: str) -> dict:
        """Hand-overs between resources."""
        if not self.log.events.filter(F.col("attrs")[resource_attribute].isNotNull()).limit(1).count():
            raise ValueError(f"no event has the attribute {resource_attribute!r}; there are {[r.attribute for r in traces.resource_attributes(self.log).collect()]}")
        return self._answer("Hand-overs", traces.handovers(self.log, resource_attribute, 20))

    # Cursors

    def get_total_from_cursor_id(self, cursor_id: str) -> dict:
        """Rows of a result."""
        return {"total": self.cursors.get(cursor_id).count()}

    def get_timerange_by_cursor_id(self, cursor_id: str) -> dict:
        """First and last time of a result, and the seconds between."""
        r = stats.summary(self.cursors.get(cursor_id)).first()
        return {"start": r.first_ts, "end": r.last_ts, "seconds": r.seconds}

    def get_summary_from_cursor_id(self, cursor_id: str) -> dict:
        """Rows, times, activities and object types of a result."""
        return stats.summary(self.cursors.get(cursor_id)).first().asDict()

    def intersect_cursors(self, cursor_id_1: str, cursor_id_2: str) -> dict:
        """Events in both results."""
        return self._keep("intersect_cursors", setops.intersect(self.cursors.get(cursor_id_1), self.cursors.get(cursor_id_2)))

    def union_cursors(self, cursor_id_1: str, cursor_id_2: str) -> dict:
        """Events in either result."""
        return self._keep("union_cursors", setops.union(self.cursors.get(cursor_id_1), self.cursors.get(cursor_id_2)))

    def get_cursor_results(self, cursor_id: str, limit: int | None = None) -> dict:
        """Rows of a result."""
        rows = self.cursors.get(cursor_id)
        return {"results": [r.asDict(recursive=True) for r in (rows.limit(limit) if limit else rows).collect()]}

    # The server itself

    def list_available_tools(self) -> dict:
        """All tools with their parameters."""
        return {"tools": [{"name": n, "doc": inspect.getdoc(f), "parameters": {p.name: None if p.default is p.empty else p.default for p in list(inspect.signature(f).parameters.values())[1:]}} for n, f in sorted(TOOLS.items())]}

    def get_info(self) -> dict:
        """Counts, time span and types of the log."""
        return stats.info(self.log).first().asDict()

    def get_schema(self, section: str = "events") -> dict:
        """Declared types of a section, events or objects, with their attributes."""
        types = {"events": self.log.event_types, "objects": self.log.object_types}
        if section not in types:
            raise ValueError(f"no section {section!r}; there are events and objects")
        return {r.name: [a.name for a in r.attributes or []] for r in types[section].collect()}

    @staticmethod
    def _answer(title: str, rows: DataFrame) -> dict:
        got = [r.asDict(recursive=True) for r in rows.collect()]
        return {"rows": got, "summary": render.report(title, render.table(got))}


TOOLS: dict[str, Callable[..., dict]] = {n: f for n, f in vars(Tools).items() if inspect.isfunction(f) and not n.startswith("_") and n != "call"}
