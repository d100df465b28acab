"""Table schemas of the directory model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())
TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, L, B, TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()

SITES = _struct(
    site_id=S, base_url=S, staff_directory=S, last_scraped_at=TS, latest_snapshot_id=S, created_at=TS
)
DIRECTORIES = _struct(
    base_url=S, staff_directory=S, ipeds=S, school_name=S, successful_rule=S, rule_failed_last_time=B,
    last_processed_at=TS, process_count=L, last_staff_count=L, is_active=B,
)
# One person row of a snapshot. ``ord`` is the position in the document: its order carries meaning.
MEMBERS = _struct(
    site_id=S, snapshot_date=TS, ord=L, fingerprint=S, name=S, title=S, emails=TEXTS, phones=TEXTS,
    profile_url=S, description=S, category=S, raw=TEXT_MAP,
)
SNAPSHOT_KEYS = _struct(site_id=S, snapshot_date=TS)
NESTED_MEMBER = _struct(
    fingerprint=S, name=S, title=S, emails=TEXTS, phones=TEXTS, profile_url=S, description=S, raw=TEXT_MAP
)
NESTED_SNAPSHOTS = _struct(
    site_id=S, snapshot_date=TS, run_id=S, hash=S, total_count=L,
    categories=T.ArrayType(_struct(name=S, count=L, members=T.ArrayType(NESTED_MEMBER))),
)
PROFILES = _struct(
    site_id=S, fingerprint=S, profile_url=S, canonical_name=S, title=S, emails=TEXTS, phones=TEXTS,
    first_seen_at=TS, last_seen_at=TS, categories=TEXTS, raw=TEXT_MAP,
)
DIFF = _struct(field=S, before=TEXTS, after=TEXTS)
ENTRIES = _struct(
    change_id=S, site_id=S, from_date=TS, to_date=TS, kind=S, ord=L, fingerprint=S, name=S, title=S,
    categories=TEXTS, emails=TEXTS, phones=TEXTS, profile_url=S, diffs=T.ArrayType(DIFF), raw=TEXT_MAP,
)
CHANGE_LOG = _struct(
    change_id=S, site_id=S, from_date=TS, to_date=TS, created_at=TS, added_count=L, removed_count=L, updated_count=L
)
FAILED = _struct(
    staff_directory=S, base_url=S, failure_type=S, error_message=S, html_excerpt=S, last_attempt=TS, attempt_count=L
)
EXPORT_MANIFEST = _struct(
    filename=S, file_type=S, site_id=S, record_count=L, generated_at=TS, expires_at=TS, is_active=B
)
CHALLENGE_SITES = _struct(
    staff_directory=S, base_url=S, first_detected=TS, last_detected=TS, detection_count=L, always_protected=B,
    last_success_with=S,
)
PAGES = _struct(page_id=L, url=S, html=S, rendered_html=S)
REGISTRY_JSON = _struct(
    baseUrl=S, staffDirectory=S, ipeds=S, schoolName=S, athleticWebsite=S, collegeWebsite=S, sportsCode=S
)

# Allowed failure types.
FAILURE_TYPES = ["fetch_failed", "no_data", "critical_error"]


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
