"""An object-centric event log as five DataFrames and its declared types."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


@dataclass(frozen=True)
class ObjectLog:
    """events(eid, activity, ts, attrs), objects(oid, otype), e2o(eid, oid, otype, qualifier), o2o(src_oid, tgt_oid,
    qualifier), changes(oid, otype, ts, changed_field, attrs), and the declared event_types and object_types. Where a source has
    events and their relations in one row, ``beside`` holds these rows with the events and e2o that say the same."""

    events: DataFrame
    objects: DataFrame
    e2o: DataFrame
    o2o: DataFrame
    changes: DataFrame
    event_types: DataFrame
    object_types: DataFrame
    beside: tuple[DataFrame, DataFrame, DataFrame] | None = None

    @staticmethod
    def of(events: DataFrame, objects: DataFrame, e2o: DataFrame, o2o: DataFrame | None = None, changes: DataFrame | None = None, event_types: DataFrame | None = None, object_types: DataFrame | None = None) -> ObjectLog:
        """A log from its tables; what is left out is empty, undeclared types are those in use."""
        spark = events.sparkSession
        empty = lambda s: spark.createDataFrame([], s)
        used = lambda df, c: df.select(F.col(c).alias("name")).distinct().withColumn("attributes", F.array().cast(schema.TYPES["attributes"].dataType))
        if "attrs" not in events.columns:
            events = events.withColumn("attrs", F.lit(None).cast("map<string,string>"))
        return ObjectLog(
            events.select(*schema.EVENTS.names),
            objects.select(*schema.OBJECTS.names),
            e2o.select(*schema.E2O.names),
            o2o if o2o is not None else empty(schema.O2O),
            changes if changes is not None else empty(schema.CHANGES),
            event_types if event_types is not None else used(events, "activity"),
            object_types if object_types is not None else used(objects, "otype"),
        )

    def with_rows(self, rows: DataFrame) -> ObjectLog:
        """The log with rows (eid, activity, ts, attrs, rels: an array of oid, otype, qualifier) that hold its events beside their
        relations."""
        return replace(self, beside=(self.events, self.e2o, rows.select(*schema.EVENTS.names, "rels")))

    @property
    def rows(self) -> DataFrame | None:
        """The rows of `with_rows`, so that nothing need be joined; None once events or relations are others."""
        return self.beside[2] if self.beside and self.beside[0] is self.events and self.beside[1] is self.e2o else None

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession

    def with_events(self, kept: DataFrame) -> ObjectLog:
        """The log restricted to the event ids in ``kept``; objects stay."""
        ids = kept.select("eid").distinct()
        return replace(self, events=self.events.join(ids, "eid", "left_semi"), e2o=self.e2o.join(ids, "eid", "left_semi"))

    def of_type(self, otype: str) -> ObjectLog:
        """The log seen through one object type: only its objects and relations."""
        return replace(self, objects=self.objects.filter(F.col("otype") == otype), e2o=self.e2o.filter(F.col("otype") == otype))

    def without_types(self, *otypes: str) -> ObjectLog:
        """The log without some object types."""
        return replace(self, objects=self.objects.filter(~F.col("otype").isin(*otypes)), e2o=self.e2o.filter(~F.col("otype").isin(*otypes)))
