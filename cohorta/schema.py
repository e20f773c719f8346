"""Table catalogs: Spark StructTypes with filter metadata, plus merge specs.

Each column carries ``metadata={"filterable": bool, "group": str, "kind": str}``
where ``kind`` is the catalog type name used by the filter language
(tinyint, integer, bigint, double, varchar, date, timestamp, blob).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

KIND_TO_SPARK = {
    "tinyint": T.ByteType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "varchar": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "blob": T.BinaryType(),
}

KIND_ALIASES = {"int": "integer", "int32": "integer", "datetime": "timestamp"}


def spark_type(kind: str) -> T.DataType:
    return KIND_TO_SPARK.get(KIND_ALIASES.get(kind, kind), T.StringType())


# ---------------------------------------------------------------------------
# The contact catalog (name, type, group, filterable).  Order and names must equal the warehouse files.
# ---------------------------------------------------------------------------
CONTACT_COLUMNS = (
    ("id", "bigint", "core", True),
    ("account_id", "bigint", "core", True),
    ("primary_key", "varchar", "core", True),
    ("email", "varchar", "core", True),
    ("mobile", "varchar", "core", True),
    ("first_name", "varchar", "core", True),
    ("last_name", "varchar", "core", True),
    ("created_at", "timestamp", "core", True),
    ("updated_at", "timestamp", "core", False),
    ("subscribed_on", "timestamp", "core", True),
    ("last_emailed", "timestamp", "core", True),
    ("last_sms", "timestamp", "core", True),
    ("is_opened", "tinyint", "core", True),
    ("is_clicked", "tinyint", "core", True),
    ("last_opened", "timestamp", "core", True),
    ("last_clicked", "timestamp", "core", True),
    ("campaign_sent_cnt", "integer", "core", True),
    ("campaign_opened_cnt", "integer", "core", True),
    ("campaign_clicked_cnt", "integer", "core", True),
    ("sms_campaign_sent_cnt", "integer", "core", True),
    ("email_status", "tinyint", "core", True),
    ("email_suppressed_on", "timestamp", "core", False),
    ("sms_status", "tinyint", "core", True),
    ("sms_suppressed_on", "timestamp", "core", False),
    ("is_deleted", "tinyint", "core", True),
    ("is_contact", "tinyint", "core", True),
    ("is_preview", "tinyint", "core", False),
    ("import_source", "tinyint", "core", True),
    ("domain", "varchar", "core", True),
    ("title", "varchar", "identity", True),
    ("middle_name", "varchar", "identity", True),
    ("gender", "varchar", "identity", True),
    ("date_of_birth", "date", "identity", True),
    ("age", "integer", "identity", True),
    ("language", "varchar", "identity", True),
    ("timezone", "varchar", "identity", True),
    ("nationality", "varchar", "identity", True),
    ("marital_status", "varchar", "identity", True),
    ("address_line1", "varchar", "geo", True),
    ("address_line2", "varchar", "geo", False),
    ("city", "varchar", "geo", True),
    ("state", "varchar", "geo", True),
    ("country", "varchar", "geo", True),
    ("postal_code", "varchar", "geo", True),
    ("region", "varchar", "geo", True),
    ("metro_area", "varchar", "geo", True),
    ("latitude", "double", "geo", True),
    ("longitude", "double", "geo", True),
    ("company", "varchar", "firmographic", True),
    ("job_title", "varchar", "firmographic", True),
    ("department", "varchar", "firmographic", True),
    ("industry", "varchar", "firmographic", True),
    ("seniority", "varchar", "firmographic", True),
    ("employee_count", "integer", "firmographic", True),
    ("annual_revenue", "double", "firmographic", True),
    ("company_domain", "varchar", "firmographic", True),
    ("linkedin_url", "varchar", "firmographic", False),
    ("website", "varchar", "firmographic", False),
    ("email_opt_in", "tinyint", "preference", True),
    ("sms_opt_in", "tinyint", "preference", True),
    ("push_opt_in", "tinyint", "preference", True),
    ("preferred_channel", "varchar", "preference", True),
    ("lifecycle_stage", "varchar", "preference", True),
    ("lead_source", "varchar", "preference", True),
    ("lead_score", "integer", "preference", True),
    ("do_not_call", "tinyint", "preference", True),
    ("marketing_consent_at", "timestamp", "preference", True),
    ("last_purchase_at", "timestamp", "commerce", True),
    ("first_purchase_at", "timestamp", "commerce", True),
    ("total_orders", "integer", "commerce", True),
    ("total_spend", "double", "commerce", True),
    ("ltv", "double", "commerce", True),
    ("avg_order_value", "double", "commerce", True),
    ("product_interest", "varchar", "commerce", True),
    ("rfm_score", "integer", "commerce", True),
    ("cart_value", "double", "commerce", True),
    ("last_cart_at", "timestamp", "commerce", True),
    ("subscription_plan", "varchar", "commerce", True),
    ("subscription_status", "varchar", "commerce", True),
    ("loyalty_tier", "varchar", "loyalty", True),
    ("loyalty_points", "integer", "loyalty", True),
    ("store_id", "varchar", "loyalty", True),
    ("sales_rep", "varchar", "loyalty", True),
    ("account_manager", "varchar", "loyalty", True),
    ("customer_since", "date", "loyalty", True),
    ("churn_risk", "varchar", "loyalty", True),
    ("nps_score", "integer", "loyalty", True),
    ("support_tickets", "integer", "loyalty", True),
    ("device_type", "varchar", "digital", True),
    ("os_name", "varchar", "digital", True),
    ("browser_name", "varchar", "digital", True),
    ("app_version", "varchar", "digital", True),
    ("last_login_at", "timestamp", "digital", True),
    ("session_count", "integer", "digital", True),
    ("utm_source", "varchar", "digital", True),
    ("utm_campaign", "varchar", "digital", True),
    ("utm_medium", "varchar", "digital", True),
    ("referrer", "varchar", "digital", True),
    ("segment_tag", "varchar", "misc", True),
    ("cohort", "varchar", "misc", True),
    ("persona", "varchar", "misc", True),
    ("vip_flag", "tinyint", "misc", True),
    ("test_group", "varchar", "misc", True),
    ("external_id", "varchar", "misc", True),
    ("crm_id", "varchar", "misc", True),
    ("tax_id", "varchar", "misc", False),
    ("notes", "varchar", "misc", False),
    ("custom_label_1", "varchar", "misc", True),
    ("custom_label_2", "varchar", "misc", True),
    ("custom_score_1", "integer", "misc", True),
    ("custom_score_2", "integer", "misc", True),
    ("custom_flag_1", "tinyint", "misc", True),
    ("custom_flag_2", "tinyint", "misc", True),
    ("event_attendance", "integer", "misc", True),
    ("webinar_count", "integer", "misc", True),
    ("content_downloads", "integer", "misc", True),
    ("last_email_subject", "varchar", "misc", True),
    ("preferred_send_hour", "integer", "misc", True),
)

# The lake contact ("sftp") core columns; the custom columns
# f2..f41 follow from a rule (f31 tinyint, all others varchar).
SFTP_CORE_COLUMNS = (
    ("id", "bigint", "core", True),
    ("account_id", "integer", "core", True),
    ("primary_key", "varchar", "core", True),
    ("email", "varchar", "core", True),
    ("mobile", "varchar", "core", True),
    ("created_at", "integer", "core", True),
    ("updated_at", "integer", "core", True),
    ("subscribed_on", "integer", "core", True),
    ("last_emailed", "integer", "core", True),
    ("last_sms", "integer", "core", True),
    ("is_opened", "tinyint", "core", True),
    ("is_clicked", "tinyint", "core", True),
    ("last_opened", "integer", "core", True),
    ("last_clicked", "integer", "core", True),
    ("campaign_sent_cnt", "integer", "core", True),
    ("campaign_opened_cnt", "integer", "core", True),
    ("campaign_clicked_cnt", "integer", "core", True),
    ("sms_campaign_sent_cnt", "integer", "core", True),
    ("email_status", "tinyint", "core", True),
    ("email_suppressed_on", "integer", "core", False),
    ("sms_status", "tinyint", "core", True),
    ("sms_suppressed_on", "integer", "core", False),
    ("is_deleted", "tinyint", "core", True),
    ("is_contact", "tinyint", "core", True),
    ("is_preview", "tinyint", "core", True),
    ("import_source", "tinyint", "core", True),
    ("domain", "varchar", "core", True),
    ("data", "blob", "core", False),
)


def _field(name: str, kind: str, group: str, filterable: bool) -> T.StructField:
    return T.StructField(name, spark_type(kind), True,
                         metadata={"kind": kind, "group": group, "filterable": filterable})


def contact_lake_fields() -> list[T.StructField]:
    # lake columns f4..f14 are varchar and filterable
    return [_field(f"f{i}", "varchar", "lake", True) for i in range(4, 15)]


CHANGE_FIELDS = [
    T.StructField("_op", T.StringType(), True),
    T.StructField("_ts", T.TimestampType(), True),
    T.StructField("_seq", T.LongType(), True),
]

CONTACT = T.StructType([*(_field(*c) for c in CONTACT_COLUMNS), *contact_lake_fields()])
SFTP_CONTACT = T.StructType(
    [_field(*c) for c in SFTP_CORE_COLUMNS]
    + [_field(f"f{i}", "tinyint" if i == 31 else "varchar", "custom", True) for i in range(2, 42)]
)


def _simple(spec: str) -> T.StructType:
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        fields.append(_field(name, kind, "core", True))
    return T.StructType(fields)


# Warehouse table layouts (column order as stored).
CAMPAIGN_SUB = _simple(
    "campaign_id bigint, primary_key varchar, version_id bigint, contact_id bigint, "
    "recipient varchar, attributes varchar, message_size integer, sent_on timestamp, "
    "priority tinyint, queue_id integer, connection_id integer, status tinyint, "
    "total_open tinyint, total_click tinyint, drop_reason varchar, soft_bounce_retry tinyint, "
    "total_open_amp tinyint, total_click_amp tinyint, message_id varchar, channel varchar, "
    "dlr_code varchar, dlr_at timestamp")
CAMPAIGN = _simple(
    "id bigint, account_id bigint, name varchar, channel varchar, segment_id varchar, "
    "status varchar, created_at timestamp, launched_at timestamp, queued_cnt bigint")
SEGMENT = _simple(
    "id varchar, account_id bigint, name varchar, filter_json varchar, "
    "created_at timestamp, updated_at timestamp")
CAMPAIGN_ACTIVITY = _simple(
    "id bigint, version_id bigint, contact_id bigint, action tinyint, link_id tinyint, "
    "user_agent varchar, ip varchar, created_at timestamp, device varchar, "
    "device_type tinyint, browser varchar, dt date")
DLR_EVENT = _simple(
    "id varchar, message_id varchar, campaign_id bigint, channel varchar, status tinyint, "
    "code varchar, reason varchar, created_at timestamp, dt date")
API_LOGS = _simple(
    "channel_id integer, message_id varchar, request_hour tinyint, sent_ip varchar, "
    "connection_id integer, mta_route_id integer, type tinyint, status tinyint, "
    "recipient varchar, opened tinyint, clicked tinyint, is_unsubscribed tinyint, "
    "is_spammed tinyint, updated_at integer, data varchar, recipient_domain varchar, "
    "sender_domain varchar, template_id varchar, unique_arguments varchar, dt date")
RECEIPT = _simple(
    "message_id varchar, campaign_id bigint, channel varchar, status integer, code varchar, reason varchar, "
    "received_at timestamp, seq bigint, dt date")
#: Receipts that could not be applied, whole, with their identity and the reason.
DLR_REJECT = _simple(
    "id varchar, message_id varchar, campaign_id bigint, channel varchar, status integer, code varchar, reason varchar, "
    "received_at timestamp, seq bigint, error varchar, dt date")
IMPORT_REJECT = _simple(
    "table_name varchar, source varchar, row varchar, error varchar, rejected_at timestamp, dt date")
BLOCK_FILE_DATA = _simple("block_file_id bigint, unique_identifier varchar")


def with_change_columns(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + CHANGE_FIELDS)


#: Log rows as stored, with the receipt that each stands for: two receipts may log the same.
API_LOGS_STORED = T.StructType([*with_change_columns(API_LOGS).fields, T.StructField("_receipt", T.StringType(), True)])


def stored_layout(schema: T.StructType) -> T.StructType:
    """Change rows as the warehouse stores them, with the tie value."""
    return T.StructType([*with_change_columns(schema).fields, T.StructField("_tie", T.LongType(), True)])


@dataclass(frozen=True)
class MergeSpec:
    """How a mutable table is merged: key, ordering, tombstone rule.

    One spec per table is used by both the read path and compaction.
    """
    key: tuple[str, ...]
    order: tuple[str, ...] = ("_ts", "_seq")
    null_op_is_upsert: bool = False
    partition_by: tuple[str, ...] = ()
    payload: tuple[str, ...] = field(default=())


CONTACT_SPEC = MergeSpec(key=("account_id", "id"), partition_by=("account_id",),
                         payload=tuple(CONTACT.fieldNames()))
# exact (_ts, _seq) ties between receipts: the higher status, then code, wins
CAMPAIGN_SUB_SPEC = MergeSpec(key=("campaign_id", "message_id"), order=("_ts", "_seq", "status", "dlr_code"),
                              partition_by=("campaign_id",),
                              payload=tuple(CAMPAIGN_SUB.fieldNames()))
CAMPAIGN_SPEC = MergeSpec(key=("account_id", "id"), partition_by=("account_id",),
                          payload=tuple(CAMPAIGN.fieldNames()))
API_LOGS_SPEC = MergeSpec(key=("message_id",), order=("updated_at", "_ts", "_seq"),
                          null_op_is_upsert=True, partition_by=("dt",),
                          payload=tuple(API_LOGS.fieldNames()))


class Catalog:
    """Name lookup over a StructType with filter metadata."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self._by_name = {f.name: f for f in schema.fields}

    def get(self, name: str) -> T.StructField | None:
        return self._by_name.get(name)

    def kind(self, name: str) -> str:
        f = self._by_name[name]
        return (f.metadata or {}).get("kind") or _kind_of(f.dataType)

    def filterable(self, name: str) -> bool:
        f = self._by_name.get(name)
        return bool(f is not None and (f.metadata or {}).get("filterable", True))

    def names(self) -> list[str]:
        return list(self._by_name)

    def filterable_names(self) -> list[str]:
        return [n for n in self._by_name if self.filterable(n)]


def _kind_of(dt: T.DataType) -> str:
    for k, v in KIND_TO_SPARK.items():
        if type(v) is type(dt):
            return k
    if isinstance(dt, T.TimestampNTZType):
        return "timestamp"
    if isinstance(dt, (T.ShortType,)):
        return "integer"
    return "varchar"


def catalog_for(schema_or_df) -> Catalog:
    schema = getattr(schema_or_df, "schema", schema_or_df)
    return Catalog(schema)


def sftp_catalog_for(df) -> Catalog:
    """Catalog of the lake contact table restricted to the columns a frame has,
    with the frame's actual types (keeps metadata of the fixed catalog)."""
    base = {f.name: f for f in SFTP_CONTACT.fields}
    fields = []
    for f in df.schema.fields:
        meta = dict(base[f.name].metadata) if f.name in base else {
            "kind": _kind_of(f.dataType), "group": "extra", "filterable": True}
        fields.append(T.StructField(f.name, f.dataType, True, metadata=meta))
    return Catalog(T.StructType(fields))
