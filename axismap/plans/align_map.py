"""The map object and its builder."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axismap.operators import canonical, coarsen, export, lift, members, query
from axismap.schema import GROUPS, MEMBERS, META, RUNS, SECTIONS, MapError, as_runs, other
from axismap.sources import container, store, text


def _meta(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(values.items()), META)


@dataclass(frozen=True)
class Params:
    """How a map is stored: runs per chunk (0: as they come), span of a chunk in its directory, compression."""

    chunk_runs: int = 0
    chunk_span: int = store.CHUNK_SPAN
    codec: str = "zstd"


@dataclass(frozen=True)
class AlignMap:
    """An immutable map: canonical runs, members, groups, metadata and sections.

    Methods return DataFrames, values or new maps. What checks its input (windows, new
    maps), reads a value, or measures windows runs a job at once.
    """

    runs: DataFrame
    members: DataFrame
    groups: DataFrame
    meta: DataFrame
    sections: DataFrame
    path: str | None = None
    params: Params = Params()

    @property
    def spark(self) -> SparkSession:
        return self.runs.sparkSession

    # sources and sinks
    @classmethod
    def read(cls, spark: SparkSession, path: str) -> AlignMap:
        return cls(*store.read(spark, path), path)

    def write(self, path: str) -> None:
        order = self.meta_value("order") or "a"
        store.write(path, self.runs, self.members, self.groups, self.meta, self.sections, order, self.params.codec, self.params.chunk_runs)

    @classmethod
    def read_container(cls, spark: SparkSession, path: str) -> AlignMap:
        return cls(*container.read(spark, path))

    def write_container(self, path: str, chunk_runs: int = container.CHUNK_RUNS, chunk_span: int = container.CHUNK_SPAN) -> None:
        container.write(path, self.runs, self.members, self.groups, self.meta, self.sections, chunk_runs, chunk_span)

    @classmethod
    def from_paf(cls, spark: SparkSession, path: str, swap: bool = False, **build) -> AlignMap:
        runs, found = text.paf(text.lines(spark, path), swap)
        names = ("target", "query") if swap else ("query", "target")
        return AlignMapBuilder(spark, "paf", runs, found, {"source": path, "axis.a": names[0], "axis.b": names[1]}).close(**build)

    @classmethod
    def from_chain(cls, spark: SparkSession, path: str, swap: bool = False, **build) -> AlignMap:
        runs, found = text.ucsc_chain(text.lines(spark, path), swap)
        names = ("q", "t") if swap else ("t", "q")
        return AlignMapBuilder(spark, "chain", runs, found, {"source": path, "axis.a": names[0], "axis.b": names[1]}).close(**build)

    def to_paf(self, max_gap: int = export.MAX_GAP) -> DataFrame:
        return export.paf_text(export.records(self.runs, self.members, max_gap)).orderBy("id")

    def to_chain(self, max_gap: int = export.MAX_GAP) -> DataFrame:
        return export.chain_text(export.records(self.runs, self.members, max_gap)).orderBy("id")

    def dump(self) -> DataFrame:
        return export.dump(self.runs, self.members)

    # lookups
    def meta_value(self, key: str) -> str | None:
        row = self.meta.filter(F.col("key") == key).first()
        return row["value"] if row else None

    def section(self, section_id: str) -> bytes | None:
        row = self.sections.filter(F.col("id") == section_id).first()
        return bytes(row["data"]) if row else None

    def section_list(self) -> DataFrame:
        """id and size in bytes of every section, in order of ids."""
        return self.sections.select("id", F.octet_length("data").cast("bigint").alias("bytes")).orderBy("id")

    def chunks(self) -> DataFrame:
        return store.chunk_directory(self.runs, self.params.chunk_span)

    def member(self, axis: str, name: str) -> int | None:
        row = members.by_name(self.members, axis, name).first()
        return row["member_id"] if row else None

    def member_by_rank(self, axis: str, rank: int) -> DataFrame:
        return members.by_rank(self.members, axis).filter(F.col("name_rank") == rank)

    def prefix(self, axis: str, prefix: str) -> DataFrame:
        return members.by_prefix(self.members, axis, prefix)

    def extents(self) -> DataFrame:
        return members.extents(self.members, self.runs)

    def group_members(self, axis: str, group: str) -> DataFrame:
        return members.group_members(self.members, self.groups, axis, group)

    def info(self) -> DataFrame:
        """key and value: profile, order, overlap, sequences, runs, meta.* and group.*; of a stored map also its sizes."""
        counted = self.members.groupBy("axis").agg(F.count("*").alias("n")).select(F.concat(F.lit("sequences_"), "axis").alias("key"), F.col("n").cast("string").alias("value"))
        n = self.runs.agg(F.count("*").cast("string").alias("value")).select(F.lit("runs").alias("key"), "value")
        own = self.meta.select(F.when(F.col("key").isin("profile", "order", "axis_a_overlaps"), F.col("key")).otherwise(F.concat(F.lit("meta."), "key")).alias("key"), "value")
        g = members.group_totals(self.members, self.groups).select(F.concat_ws(".", F.lit("group"), "axis", "group_name").alias("key"), F.concat(F.col("members").cast("string"), F.lit(" sequences "), F.col("total_length").cast("string"), F.lit(" bp")).alias("value"))
        every = counted.union(n).union(own).union(g)
        if self.path is None:
            return every
        chunks, size = store.sizes(self.spark, self.path)
        rate = self.runs.agg(F.format_string("%.3f", F.lit(float(size)) / F.greatest(F.count("*"), F.lit(1))).alias("value")).select(F.lit("bytes_per_run").alias("key"), "value")
        return every.union(_meta(self.spark, {"chunks": str(chunks), "payload_bytes": str(size)})).union(rate)

    def verify(self) -> str:
        """Hold the map's rules and, of a stored map, every page's checksum: "OK", or raises."""
        if self.path is not None:
            store.audit(self.spark, self.path)
        return canonical.verify(self.runs, self.members, self.groups)

    # queries
    def named(self, intervals: DataFrame, axis: str) -> DataFrame:
        """Intervals (query_id, name, lo, hi) with the member of each known name."""
        ids = self.members.filter(F.col("axis") == axis).select("name", F.col("member_id").alias("member"))
        return intervals.join(ids, "name")

    def query(self, windows: DataFrame, axis: str = "a", ordered: bool = False) -> DataFrame:
        query.check_windows(windows)
        found = query.query(self.runs, windows, axis)
        return found.orderBy(*query.QUERY_ORDER[axis]) if ordered else found

    def point(self, points: DataFrame, axis: str = "a", cap: int | None = None) -> DataFrame:
        return query.point(self.runs, points, axis) if cap is None else query.point_capped(self.runs, points, cap, axis)

    def sweep(self, windows: DataFrame, step: int, axis: str = "b") -> DataFrame:
        return query.sweep(self.runs, windows, step, axis)

    def scan(self, axis: str, member: int | None = None, others: DataFrame | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
        return query.scan(self.runs, axis, member, others, lo, hi)

    def lift(self, intervals: DataFrame, source: str = "a", max_gap: int = -1, min_match: float = 0.0, best: float = -1.0, **chain) -> DataFrame:
        """Lifted intervals (query_id, member, lo, hi); see ``operators.lift``."""
        if best >= 0 and best > 1:
            raise MapError("best must lie in 0..1")
        options = lift.LiftOptions(max_gap, best, lift.ChainParams(**chain))
        return lift.min_match(lift.lift(self.runs, intervals, source, options), intervals, min_match)

    def lift_bed(self, bed: DataFrame, source: str = "a", **options) -> tuple[DataFrame, DataFrame]:
        """(BED lines of the results, intervals without any)."""
        done = self.lift(self.named(bed, source), source, **options)
        return text.bed_lines(done, bed, self.members, other(source)), lift.unmapped(bed, done)

    # derived maps
    def _closed(self, runs: DataFrame, allow_overlap: bool, **changed) -> AlignMap:
        """A map of new canonical runs: its order and overlap flag are those of the runs; refused if they may not overlap."""
        runs = runs.persist()
        chosen = canonical.storage_order(runs, "a", allow_overlap).first()
        if chosen["refused"]:
            raise MapError(f"{chosen['overlapping_runs']} runs overlap on axis a")
        meta = changed.pop("meta", self.meta).filter("key not in ('order', 'axis_a_overlaps')")
        told = _meta(self.spark, {"order": chosen["order"], "axis_a_overlaps": "yes" if chosen["axis_a_overlaps"] else "no"})
        return replace(self, runs=runs, meta=meta.union(told), path=None, **changed)

    def swap(self, allow_overlap: bool = False) -> AlignMap:
        """Axes exchanged; refused if the new axis a overlaps, unless that is allowed."""
        flipped = lambda df: df.withColumn("axis", F.when(F.col("axis") == "a", "b").otherwise("a"))
        return self._closed(swap_axes(self.runs), allow_overlap, members=flipped(self.members), groups=flipped(self.groups))

    def coarsen(self, key: str, max_gap: int) -> AlignMap:
        """The map with runs joined over gaps; overlap is allowed, and the order chosen anew."""
        if max_gap < 0:
            raise MapError("max_gap must not be negative")
        lengths = self.members.filter(F.col("axis") == other(key)).select("member_id", "length")
        runs = coarsen.coarsen(self.runs, key, max_gap, lengths)
        widest = max(max_gap, int(self.meta_value("max_gap") or 0))
        meta = self.meta.filter("key != 'max_gap'").union(_meta(self.spark, {"max_gap": str(widest)}))
        return self._closed(runs, True, meta=meta)


def swap_axes(runs: DataFrame) -> DataFrame:
    return as_runs(runs).select(F.col("b_member").alias("a_member"), F.col("b").alias("a"), F.col("a_member").alias("b_member"), F.col("a").alias("b"), "len", "strand")


class AlignMapBuilder:
    """Collects runs, members, groups, metadata and sections, and closes to a map.

    Nothing is checked before ``close``, which refuses what breaks a map's rules.
    """

    def __init__(self, spark: SparkSession, profile: str, runs: DataFrame | None = None, found: DataFrame | None = None, meta: dict[str, str] | None = None) -> None:
        if len(profile.encode()) > 31:
            raise MapError("a profile has at most 31 bytes")
        self.spark, self.profile = spark, profile
        self._runs = runs if runs is not None else spark.createDataFrame([], RUNS)
        self._members = found if found is not None else spark.createDataFrame([], MEMBERS)
        self._groups = spark.createDataFrame([], GROUPS)
        self._meta, self._sections = dict(meta or {}), {}
        self._copied: DataFrame | None = None
        self._named: dict[str, list[str]] = {"a": [], "b": []}
        self._joined: dict[tuple[str, int], int] = {}
        self._params, self._sequence = Params(), None

    def add_members(self, axis: str, names: list[tuple[str, int]]) -> AlignMapBuilder:
        first = self._members.filter(F.col("axis") == axis).count()
        rows = [(axis, first + k, n, size, None) for k, (n, size) in enumerate(names)]
        self._members = self._members.unionByName(self.spark.createDataFrame(rows, MEMBERS))
        return self

    def add_runs(self, runs: DataFrame) -> AlignMapBuilder:
        self._runs = as_runs(self._runs).unionByName(as_runs(runs))
        return self

    def set_meta(self, key: str, value: str) -> AlignMapBuilder:
        if not 1 <= len(key.encode()) <= 255 or "\0" in key + value:
            raise MapError(f"bad metadata key {key!r}")
        self._meta[key] = value
        return self

    def add_section(self, section_id: str, data: bytes) -> AlignMapBuilder:
        if not section_id.startswith("x.") or section_id in self._sections:
            raise MapError(f"a section id must be new and start with x.: {section_id!r}")
        self._sections[section_id] = data
        return self

    def group_by_name(self, separator: str, fields: int = 1) -> AlignMapBuilder:
        self._members, self._groups = members.assign_groups(self._members, separator, fields)
        return self

    def add_group(self, axis: str, name: str) -> int:
        """The id of a new group: ids follow the order of declaration. A name that is there is refused."""
        if not name or name in self._named[axis]:
            raise MapError(f"a group name must be new and not empty: {name!r}")
        self._named[axis].append(name)
        return len(self._named[axis]) - 1

    def set_member_group(self, axis: str, member: int, group: int) -> AlignMapBuilder:
        """Put a member into a group declared with ``add_group``; a later call for a member holds."""
        if not 0 <= group < len(self._named[axis]):
            raise MapError(f"no group {group} on axis {axis}")
        self._joined[axis, member] = group
        return self

    def set_params(self, chunk_runs: int = 0, chunk_span: int = store.CHUNK_SPAN, codec: str = "zstd") -> AlignMapBuilder:
        if chunk_runs < 0 or chunk_span < 1 or codec not in ("zstd", "snappy", "gzip", "none"):
            raise MapError("bad chunk parameters")
        self._params = Params(chunk_runs, chunk_span, codec)
        return self

    def set_presorted(self, runs: DataFrame, sequence: str) -> AlignMapBuilder:
        """Runs that claim to come member by member along axis a, in the order of the column ``sequence``; ``close`` refuses others."""
        self._sequence = runs.withColumnRenamed(sequence, "seq")
        return self.add_runs(runs)

    def copy_layout(self, source: AlignMap) -> AlignMapBuilder:
        self._members, self._groups = source.members, source.groups
        self._meta |= {r["key"]: r["value"] for r in source.meta.collect()}
        self._copied = source.sections
        return self

    def _grouped(self) -> None:
        """Add declared groups, and put members into theirs."""
        rows = [(axis, k, name) for axis, names in self._named.items() for k, name in enumerate(names)]
        if not rows:
            return
        if not self._groups.isEmpty():
            raise MapError("groups are either declared one by one or come from names or another map")
        self._groups = self.spark.createDataFrame(rows, GROUPS)
        put = self.spark.createDataFrame([(a, m, g) for (a, m), g in self._joined.items()], "axis string, member_id bigint, own_group bigint")
        if lost := put.join(self._members, ["axis", "member_id"], "left_anti").first():
            raise MapError(f"no member {lost['member_id']} on axis {lost['axis']}")
        met = self._members.join(F.broadcast(put), ["axis", "member_id"], "left")
        self._members = met.select("axis", "member_id", "name", "length", F.coalesce("own_group", "group_id").alias("group_id"))

    def close(self, allow_overlap: bool = False, order: str = "a", group_sep: str | None = None, group_fields: int = 1) -> AlignMap:
        if group_sep:
            self.group_by_name(group_sep, group_fields)
        self._grouped()
        if self._sequence is not None:
            faults = canonical.check_presorted(self._sequence, "seq").first()
            if faults["revisited"] or faults["backwards"]:
                raise MapError(f"runs are not presorted: {faults['revisited']} members are not contiguous, {faults['backwards']} runs go backwards")
        canonical.verify(self._runs, self._members, self._groups)
        runs = canonical.canonical_runs(self._runs).persist()
        chosen = canonical.storage_order(runs, order, allow_overlap).first()
        if chosen["refused"]:
            raise MapError(f"{chosen['overlapping_runs']} runs overlap on axis a")
        meta = self._meta | {"profile": self.profile, "order": chosen["order"], "axis_a_overlaps": "yes" if chosen["axis_a_overlaps"] else "no"}
        sections = self.spark.createDataFrame(sorted((k, bytearray(v)) for k, v in self._sections.items()), SECTIONS)
        if self._copied is not None:
            sections = self._copied.filter(~F.col("id").isin(list(self._sections))).union(sections)
        return AlignMap(runs, self._members, self._groups, _meta(self.spark, meta), sections, params=self._params)

    def stats(self) -> DataFrame:
        """One row: input_runs, runs, overlapping_runs."""
        runs = canonical.canonical_runs(self._runs)
        one = self._runs.agg(F.count("*").alias("input_runs")).crossJoin(runs.agg(F.count("*").alias("runs")))
        return one.crossJoin(canonical.overlap_count(runs))  # one row each
