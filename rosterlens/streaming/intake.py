"""Incremental intake: person rows arrive as files, each batch extends snapshots, profiles and change logs.

The tables are laid out in a fixed number of buckets, by a hash of the site. A batch reads and
rewrites the buckets of its own sites only: their numbers, at most as many as there are buckets,
become a partition filter of every read. A row that is already known is left out, so a batch that is
delivered again after a failure changes nothing. The tables are those that one batch of all rows
would leave, however the rows were split into batches and ordered: a site whose rows come late
is built anew from the rows taken in so far, which are kept - in one pass, however many dates they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rosterlens import schemas
from rosterlens.operators.compare import PAIR, compare_fuzzy
from rosterlens.operators.identity import profiles_from, resolve_history, resolve_identity, to_members, upsert_profiles
from rosterlens.operators.nesting import SNAPSHOT
from rosterlens.operators.ordered import grouped_rank
from rosterlens.operators.snapshots import adjacent_pairs, newest_dates, snapshot_dates
from rosterlens.plans.changes import build_change_log
from rosterlens.session import stage, stage_scope
from rosterlens.sources.tables import bucket_of, read_buckets, read_table, write_buckets

_TEXTS = ["name", "title", "email", "phone", "category", "profile_url"]
PEOPLE_SCHEMA = T.StructType(
    [T.StructField("site_id", T.StringType()), T.StructField("snapshot_date", T.TimestampType()), T.StructField("ord", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in _TEXTS]
)
ARRIVALS = T.StructType([*PEOPLE_SCHEMA.fields, T.StructField("row_id", T.BinaryType())])
BUCKETS = 64


def row_id() -> Column:
    """What makes a row itself: its site, date, order number and content. Two rows of one order number are two rows."""
    return F.unhex(F.sha2(F.to_json(F.struct(*PEOPLE_SCHEMA.names)), 256))


def without_ties(people: DataFrame) -> DataFrame:
    """Order numbers that are unique in their snapshot, as the ordered rules need.

    Files of one snapshot may each count from 0. A snapshot in which a number repeats is numbered
    anew from 0, by the given number, then content; all others keep theirs.
    """
    tied = stage(people.groupBy(*SNAPSHOT, "ord").agg(F.count("*").alias("_n")).where("_n > 1").select(*SNAPSHOT).distinct(), "tied")
    if tied.isEmpty():
        return people
    ranked = grouped_rank(people.join(tied, SNAPSHOT, "left_semi"), SNAPSHOT, ["ord", "row_id"], "_place")
    again = ranked.withColumn("ord", F.col("_place") - 1).select(*people.columns)
    return people.join(tied, SNAPSHOT, "left_anti").unionByName(again)


class Intake:
    """The tables of an intake under one root folder. The number of buckets is fixed by the first batch."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._wanted, self._known = buckets, None

    @property
    def buckets(self) -> int:
        if self._known is None:
            layout = read_table(self.spark, f"{self.root}/layout", T.StructType([T.StructField("buckets", T.IntegerType())]))
            row = layout.first()
            if row is None:
                self.spark.createDataFrame([(self._wanted,)], layout.schema).write.mode("overwrite").parquet(f"{self.root}/layout")
            self._known = self._wanted if row is None else row[0]
        return self._known

    def _read(self, name: str, schema: T.StructType, numbers: list[int] | None = None) -> DataFrame:
        return read_buckets(self.spark, f"{self.root}/{name}", schema, numbers)

    def members(self, numbers: list[int] | None = None) -> DataFrame:
        return self._read("members", schemas.MEMBERS, numbers)

    def profiles(self, numbers: list[int] | None = None) -> DataFrame:
        return self._read("profiles", schemas.PROFILES, numbers)

    def arrivals(self, numbers: list[int] | None = None) -> DataFrame:
        """Every person row ever taken in, also of snapshots that were retired since."""
        return self._read("arrivals", ARRIVALS, numbers)

    def change_log(self) -> DataFrame:
        """Logs between neighbouring kept snapshots; others were retired with their snapshots."""
        return self._read("change_log", schemas.CHANGE_LOG).where("to_date is not null")

    def entries(self) -> DataFrame:
        return self._read("entries", schemas.ENTRIES).join(self.change_log().select("change_id"), "change_id", "left_semi")

    def take(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Process one batch of person rows.

        A site with one new snapshot, later than those it has, goes on from its profiles. Where rows
        come late - a further part of a known snapshot, or an older snapshot - or bring several
        snapshots, the site is built anew from all its rows: identities depend on those before.
        Equal rows (all columns) are one row, within a batch and across batches.
        """
        with stage_scope(self.spark):
            self._take(batch)

    def _take(self, batch: DataFrame) -> None:
        # A stream's own session plans without adaptive execution; the work is done in the caller's.
        # Equal rows have equal columns: a distinct is hashed, where keeping the first row of each id would sort whole rows.
        arrived = stage(batch.select(*PEOPLE_SCHEMA.names).distinct().withColumn("row_id", row_id()), "batch", self.spark)
        number = bucket_of(F.col("site_id"), self.buckets)
        span = arrived.agg(F.min("snapshot_date"), F.max("snapshot_date"), F.sort_array(F.collect_set(number))).first()
        first, last, numbers = span
        if first is None:
            return
        same_time = self.arrivals(numbers).where(F.col("snapshot_date").between(first, last))
        fresh = stage(arrived.join(same_time, "row_id", "left_anti").select(*ARRIVALS.names), "fresh")
        if fresh.isEmpty():
            return
        sites = stage(self._touched(fresh, numbers), "touched-sites")
        anew, onward = sites.where("anew").select("site_id"), sites.where("not anew").select("site_id")

        def of(table: DataFrame, some: DataFrame) -> DataFrame:
            return table.join(some, "site_id", "left_semi")

        n_anew, n_onward = sites.agg(F.count_if("anew"), F.count_if(~F.col("anew"))).first()
        rebuilt = new = schemas.empty(self.spark, schemas.MEMBERS)
        known = of(self.profiles(numbers), onward)
        if n_anew:
            # A row is fresh or was taken in before, never both, and was distinct when it came.
            history = without_ties(of(fresh, anew).unionByName(of(self.arrivals(numbers), anew)))
            rebuilt = stage(to_members(resolve_history(history.drop("row_id"))), "rebuilt")
        if n_onward:
            new = stage(to_members(resolve_identity(without_ties(of(fresh, onward)).drop("row_id"), known)), "identified")
        profiles = profiles_from(rebuilt).unionByName(upsert_profiles(known, new))
        members = rebuilt.unionByName(new.select(*rebuilt.columns))
        everyone = of(self.members(numbers), onward).select(*rebuilt.columns).unionByName(members)

        # Only what stays is compared: pairs of kept snapshots of which one is new.
        dates = stage(newest_dates(snapshot_dates(everyone), self.keep), "kept-dates")
        kept = stage(everyone.join(dates, SNAPSHOT, "left_semi"), "kept")
        fresh_dates = snapshot_dates(members).withColumn("_new", F.lit(True))
        pairs = adjacent_pairs(dates)
        for date in ("from_date", "to_date"):
            mark = fresh_dates.select("site_id", F.col("snapshot_date").alias(date), F.col("_new").alias(f"_{date}"))
            pairs = pairs.join(mark, ["site_id", date], "left")
        pairs = stage(pairs.select(*PAIR, F.coalesce("_from_date", "_to_date", F.lit(False)).alias("is_new")), "pairs")
        new_pairs = pairs.where("is_new").drop("is_new")
        sides = [new_pairs.select("site_id", F.col(date).alias("snapshot_date")) for date in ("from_date", "to_date")]
        compared = kept.join(sides[0].unionByName(sides[1]).distinct(), SNAPSHOT, "left_semi")
        new_entries = schemas.empty(self.spark, schemas.ENTRIES)
        if not new_pairs.isEmpty():
            new_entries = stage(compare_fuzzy(compared, new_pairs), "entries")
        logs = self._read("change_log", schemas.CHANGE_LOG, numbers).join(pairs.where("not is_new"), PAIR, "left_semi")
        all_logs = stage(logs.unionByName(build_change_log(new_entries).select(*logs.columns)), "logs")
        old_entries = self._read("entries", schemas.ENTRIES, numbers).join(logs.select("change_id"), "change_id", "left_semi")
        # a site without a log keeps its bucket: a row without a pair stands for it
        none = sites.join(all_logs.select("site_id"), "site_id", "left_anti").select(
            *[F.col(f.name) if f.name == "site_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in all_logs.schema]
        )
        self._replace("entries", schemas.ENTRIES, old_entries.unionByName(new_entries.select(*old_entries.columns)), sites, numbers, ["change_id", "ord"])
        self._replace("change_log", schemas.CHANGE_LOG, all_logs.unionByName(none), sites, numbers, ["to_date"])
        self._replace("profiles", schemas.PROFILES, profiles, sites, numbers, ["fingerprint"])
        self._replace("members", schemas.MEMBERS, kept, sites, numbers, ["snapshot_date", "ord"])
        # Last: rows count as taken only when everything else is written.
        write_buckets(fresh, f"{self.root}/arrivals", self.buckets, ["snapshot_date", "ord"], "append")

    def _touched(self, fresh: DataFrame, numbers: list[int]) -> DataFrame:
        """(site_id, anew) of the batch's sites. Members count too: a batch that failed before its rows were recorded may have written them."""
        new = fresh.groupBy("site_id").agg(F.min("snapshot_date").alias("first_new"), F.countDistinct("snapshot_date").alias("n"))
        dates = snapshot_dates(self.arrivals(numbers)).unionByName(snapshot_dates(self.members(numbers)))
        last_known = dates.groupBy("site_id").agg(F.max("snapshot_date").alias("last_known"))
        late = (F.col("n") > 1) | F.coalesce(F.col("first_new") <= F.col("last_known"), F.lit(False))
        return new.join(last_known, "site_id", "left").select("site_id", late.alias("anew"))

    def _replace(self, name: str, schema: T.StructType, rows: DataFrame, sites: DataFrame, numbers: list[int], order: list[str]) -> None:
        """Put the rows of the touched sites in place of theirs; neighbours in the same buckets stay."""
        others = self._read(name, schema, numbers).join(sites, "site_id", "left_anti")
        write_buckets(others.unionByName(rows.select(*others.columns)), f"{self.root}/{name}", self.buckets, order)

    def start(self, source: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
        """Take in everything that has arrived in the source folder, then stop."""
        rows = self.spark.readStream.schema(PEOPLE_SCHEMA).format(fmt).load(source)
        return (
            rows.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
