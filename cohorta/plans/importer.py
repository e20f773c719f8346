"""Import jobs: source file -> canonical table rows -> snapshot or delta.

The canonicalisers are pure DataFrame -> DataFrame projections (one
``select``), so they run inside whole-stage codegen; the row count of what
was written comes from an ``Observation`` on the same job (no re-scan).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohorta import schema as S
from cohorta.functions.coerce import email_domain, epoch_or_timestamp, safe_cast, safe_int
from cohorta.session import scratch_dir
from cohorta.sources.readers import read_source, source_columns
from cohorta.sources.warehouse import Warehouse
from cohorta.sources.writers import observed

# Contact columns with a default when the source gives none.
DEFAULT_ONE = ("email_status", "sms_status", "is_contact", "import_source")
DEFAULT_ZERO = ("is_deleted", "is_preview", "is_opened", "is_clicked")
NOW_TIMESTAMPS = ("created_at", "updated_at", "subscribed_on")


def _parsed(wh: Warehouse, path: str) -> DataFrame:
    """The rows of a source, parsed once: what is taken and what is rejected read them from the shared folder."""
    src = read_source(wh.spark, path)
    kept = scratch_dir(wh.spark, "import-rows")
    src.write.mode("overwrite").parquet(kept)
    return wh.spark.read.schema(src.schema).parquet(kept)


def _src(cols: dict[str, str], name: str):
    real = cols.get(name.lower())
    return F.col(f"`{real}`") if real else F.lit(None).cast("string")


def canonical_contacts(src: DataFrame, account_id: int, now: _dt.datetime,
                       target=S.CONTACT) -> DataFrame:
    """Every target column from the source (case-insensitive), coerced;
    missing -> NULL or its default; rows without a numeric id are rejected."""
    cols = source_columns(src)
    now_lit = F.lit(now).cast("timestamp")
    out = []
    for f in target.fields:
        name, kind = f.name, f.metadata["kind"]
        s = _src(cols, name)
        derived = name in ("account_id", "primary_key", "domain") or name in NOW_TIMESTAMPS
        if name.lower() not in cols and not derived:
            default = 1 if name in DEFAULT_ONE else 0 if name in DEFAULT_ZERO else None
            c = F.lit(default)          # nothing to parse
        elif name == "account_id":
            c = F.lit(int(account_id)).cast("bigint")
        elif name == "primary_key":
            # the parsed id (not its raw text such as ' 7 ' or '7.0') is the last fallback
            c = F.coalesce(_src(cols, "primary_key").cast("string"), _src(cols, "email").cast("string"),
                           safe_int(_src(cols, "id"), "bigint").cast("string"))
        elif name == "domain":
            c = email_domain(_src(cols, "email"), _src(cols, "domain").cast("string"))
        elif kind == "timestamp":
            c = epoch_or_timestamp(s)
            if name in NOW_TIMESTAMPS:
                c = F.coalesce(c, now_lit)
        elif name in DEFAULT_ONE:
            c = F.coalesce(safe_int(s, "tinyint"), F.lit(1).cast("tinyint"))
        elif name in DEFAULT_ZERO:
            c = F.coalesce(safe_int(s, "tinyint"), F.lit(0).cast("tinyint"))
        else:
            c = safe_cast(s, kind)
        out.append(c.cast(f.dataType).alias(name))
    key = safe_int(_src(cols, "id"), "bigint")
    out += [F.lit("upsert").alias("_op"), now_lit.alias("_ts"),
            F.coalesce(key, F.lit(0)).cast("bigint").alias("_seq")]
    return src.filter(key.isNotNull()).select(*out)


def canonical_subscribers(src: DataFrame, campaign_id: int, now: _dt.datetime) -> DataFrame:
    cols = source_columns(src)
    g = lambda n: _src(cols, n)
    contact = safe_int(g("contact_id"), "bigint")
    t = lambda n, k, d: F.coalesce(safe_int(g(n), k), F.lit(d).cast(S.spark_type(k)))
    sel = [
        F.coalesce(safe_int(g("campaign_id"), "bigint"), F.lit(int(campaign_id)).cast("bigint")).alias("campaign_id"),
        F.coalesce(g("primary_key").cast("string"), g("recipient").cast("string"), contact.cast("string")).alias("primary_key"),
        t("version_id", "bigint", 1).alias("version_id"),
        contact.alias("contact_id"),
        g("recipient").cast("string").alias("recipient"),
        F.coalesce(g("attributes").cast("string"), F.lit("{}")).alias("attributes"),
        t("message_size", "integer", 0).alias("message_size"),
        epoch_or_timestamp(g("sent_on")).alias("sent_on"),
        t("priority", "tinyint", 0).alias("priority"),
        safe_int(g("queue_id"), "integer").alias("queue_id"),
        t("connection_id", "integer", 0).alias("connection_id"),
        t("status", "tinyint", 0).alias("status"),
        t("total_open", "tinyint", 0).alias("total_open"),
        t("total_click", "tinyint", 0).alias("total_click"),
        g("drop_reason").cast("string").alias("drop_reason"),
        t("soft_bounce_retry", "tinyint", 1).alias("soft_bounce_retry"),
        t("total_open_amp", "tinyint", 0).alias("total_open_amp"),
        t("total_click_amp", "tinyint", 0).alias("total_click_amp"),
        F.coalesce(g("message_id").cast("string"),
                   F.format_string("msg-%d-%s", F.lit(int(campaign_id)), contact.cast("string"))).alias("message_id"),
        F.coalesce(g("channel").cast("string"), F.lit("email")).alias("channel"),
        g("dlr_code").cast("string").alias("dlr_code"),
        epoch_or_timestamp(g("dlr_at")).alias("dlr_at"),
        F.lit("upsert").alias("_op"),
        F.lit(now).cast("timestamp").alias("_ts"),
        contact.alias("_seq"),  # deterministic sequence, no global numbering
    ]
    return src.filter(contact.isNotNull()).select(*sel)


def canonical_activity(src: DataFrame, dt: str, now: _dt.datetime) -> DataFrame:
    day = _dt.date.fromisoformat(dt)  # raises for a malformed dt
    cols = source_columns(src)
    g = lambda n: _src(cols, n)
    idc = safe_int(g("id"), "bigint")
    sel = [
        idc.alias("id"),
        F.coalesce(safe_int(g("version_id"), "bigint"), F.lit(1).cast("bigint")).alias("version_id"),
        safe_int(g("contact_id"), "bigint").alias("contact_id"),
        F.coalesce(safe_int(g("action"), "tinyint"), F.lit(1).cast("tinyint")).alias("action"),
        safe_int(g("link_id"), "tinyint").alias("link_id"),
        g("user_agent").cast("string").alias("user_agent"),
        g("ip").cast("string").alias("ip"),
        F.coalesce(epoch_or_timestamp(g("created_at")), F.lit(now).cast("timestamp")).alias("created_at"),
        g("device").cast("string").alias("device"),
        safe_int(g("device_type"), "tinyint").alias("device_type"),
        g("browser").cast("string").alias("browser"),
        F.lit(day).alias("dt"),
    ]
    return src.filter(idc.isNotNull()).select(*sel)


def _now(now: _dt.datetime | None) -> _dt.datetime:
    return now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def _rejected(wh: Warehouse, src: DataFrame, bad: Column, table: str, path: str, error: str, now: _dt.datetime) -> int:
    """Keep source rows that cannot be imported, as JSON with the reason."""
    seen = Observation(f"rejected_{table}")
    rows = (src.filter(bad).observe(seen, F.count(F.lit(1)).alias("rows"))
            .select(F.lit(table).alias("table_name"), F.lit(path).alias("source"),
                    F.to_json(F.struct(*[F.col(f"`{c}`") for c in src.columns])).alias("row"),
                    F.lit(error).alias("error"), F.lit(now).cast("timestamp").alias("rejected_at"),
                    F.lit(now.date()).alias("dt")))
    wh.append("import_reject", rows)
    return observed(seen, "rows")


def import_contacts(wh: Warehouse, path: str, account_id: int, mode: str = "delta",
                    now: _dt.datetime | None = None) -> dict:
    """Import a file into the contact table; ``mode`` snapshot replaces the
    account's snapshot partition (also by an empty one), delta appends a change
    batch.  Rows without a numeric id go to ``import_reject``."""
    if mode not in ("", "delta", "snapshot"):
        raise ValueError("mode must be snapshot or delta")
    now = _now(now)
    src = _parsed(wh, path)
    seen = Observation("import_contacts")
    rows = canonical_contacts(src, account_id, now).observe(seen, F.count(F.lit(1)).alias("rows"))
    if mode == "snapshot":
        wh.replace_partition("contact", rows, account_id)
    else:
        wh.write_delta("contact", rows, now.date())
    no_id = safe_int(_src(source_columns(src), "id"), "bigint").isNull()
    return {"table": "contact", "rows": observed(seen, "rows"), "mode": mode or "delta", "source": path,
            "rejected": _rejected(wh, src, no_id, "contact", path, "no numeric id", now)}


def import_subscribers(wh: Warehouse, path: str, campaign_id: int, mode: str = "delta",
                       now: _dt.datetime | None = None) -> dict:
    """Import recipients of one campaign.  Rows that name another campaign, or no
    numeric contact id, go to ``import_reject``; other campaigns are never touched."""
    now = _now(now)
    src = _parsed(wh, path)
    cols = source_columns(src)
    own = F.coalesce(safe_int(_src(cols, "campaign_id"), "bigint"), F.lit(int(campaign_id)).cast("bigint")) == int(campaign_id)
    no_id = safe_int(_src(cols, "contact_id"), "bigint").isNull()
    seen = Observation("import_subscribers")
    rows = canonical_subscribers(src.filter(own), campaign_id, now).observe(seen, F.count(F.lit(1)).alias("rows"))
    if mode == "snapshot":
        wh.replace_partition("campaign_sub", rows, campaign_id)
    else:
        wh.write_delta("campaign_sub", rows, now.date())
    return {"table": "campaign_sub", "rows": observed(seen, "rows"), "mode": mode, "source": path,
            "rejected": _rejected(wh, src, no_id | ~own, "campaign_sub", path, "no contact id or another campaign", now)}


def import_activity(wh: Warehouse, path: str, dt: str, now: _dt.datetime | None = None) -> dict:
    now = _now(now)
    src = _parsed(wh, path)
    seen = Observation("import_activity")
    wh.append("campaign_activity", canonical_activity(src, dt, now).observe(seen, F.count(F.lit(1)).alias("rows")))
    no_id = safe_int(_src(source_columns(src), "id"), "bigint").isNull()
    return {"table": "campaign_activity", "rows": observed(seen, "rows"), "mode": "append", "source": path,
            "rejected": _rejected(wh, src, no_id, "campaign_activity", path, "no numeric id", now)}
