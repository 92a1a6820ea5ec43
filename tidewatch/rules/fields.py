"""The fields that rules may name, and how each is found in a table of events.

A name is looked up as a column first; then come other names of columns, computed fields, and paths into the
nested documents ``ocsf`` and ``enrichment``, which may be structs, variants or JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.web import has_download, is_ipv4
from .language import RuleError

# Columns that rules may name, other names for them, paths of the nested fields.
COLUMNS = ("principal", "src_ip", "dst_ip", "domain", "url_path", "action", "http_method", "status_code", "bytes_in", "bytes_out", "user_agent", "event_key", "source_type", "ts")
ALIASES = {"status": "action", "disposition": "action"}
TEXT_PATHS = {
    "activity_name": "ocsf.activity_name",
    "status_detail": "ocsf.status_detail",
    "auth_protocol": "ocsf.auth_protocol",
    "country": "ocsf.src_endpoint.location.country",
    "city": "ocsf.src_endpoint.location.city",
    "asn": "ocsf.src_endpoint.autonomous_system.number",
    "url_supercategory": "ocsf.unmapped.url_supercategory",
    "url_category": "ocsf.http_request.url.category_ids.0",
    "threat_name": "ocsf.malware.0.name",
    "threat_category": "ocsf.malware.0.classification_ids.0",
    "dlp_engine": "ocsf.unmapped.dlp_engine",
    "dlp_dictionaries": "ocsf.unmapped.dlp_dictionaries",
    "domain_risk_tier": "enrichment.domain.tld_risk_tier",
    "registrable_domain": "enrichment.domain.registrable_domain",
}
NUMBER_PATHS = {
    "lat": "ocsf.src_endpoint.location.coordinates.lat",
    "lon": "ocsf.src_endpoint.location.coordinates.lon",
    "risk_score": "ocsf.risk_score",
}
BOOLEAN_PATHS = {
    "is_automation_tool": "enrichment.user_agent.is_automation_tool",
    "is_newly_registered_domain": "enrichment.domain.newly_registered",
    "is_hosting_src_ip": "enrichment.src_ip.is_hosting",
    "is_hosting_dst_ip": "enrichment.dst_ip.is_hosting",
}

#: Fields computed from columns of the same row.
COMPUTED = {
    "direct_to_ip": lambda: is_ipv4(F.col("domain")),
    "hour_utc": lambda: F.pmod(F.col("us") / 3.6e9, F.lit(24.0)),
    "has_download_extension": lambda: has_download(F.col("url_path")),
}
#: The field that counts rows: the events of its analysis with the row's domain.
PER_DOMAIN = "domain_event_count"
#: The column that tells analyses apart, where there is one.
ANALYSIS = "analysis_id"


def at_path(root: Column, kind: T.DataType, path: list[str]) -> Column:
    """The value at a path as text, digits being places in an array; null where the document ends before it."""
    if isinstance(kind, T.StringType):
        return F.get_json_object(root, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path))
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(root, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path), "string")
    for p in path:
        if p.isdigit() and isinstance(kind, T.ArrayType):
            root, kind = F.get(root, F.lit(int(p))), kind.elementType
        elif isinstance(kind, T.MapType):
            root, kind = F.try_element_at(root, F.lit(p)), kind.valueType
        elif isinstance(kind, T.StructType) and p in kind.names:
            root, kind = root.getField(p), kind[p].dataType
        else:
            return F.lit(None).cast("string")
    return root.cast("string")


def _path(events: DataFrame, path: str) -> Column:
    name, *rest = path.split(".")
    if name not in events.columns:
        return F.lit(None).cast("string")
    return at_path(F.col(name), events.schema[name].dataType, rest)


def column(name: str) -> Column:
    """A field that needs only the row's columns: computed, by another name, or a column."""
    if name in COMPUTED:
        return COMPUTED[name]()
    return F.col(ALIASES.get(name, name))


def with_fields(events: DataFrame, names: list[str]) -> DataFrame:
    """The events with a column for each field named; an unknown one raises.

    domain_event_count is counted per domain and joined to its rows, so that a domain with very many events is
    reduced before it meets them.
    """
    added = {}
    for name in dict.fromkeys(names):
        if name in events.columns or name in COMPUTED or name == PER_DOMAIN:
            continue
        if name in ALIASES and ALIASES[name] in events.columns:
            continue
        if name in TEXT_PATHS:
            added[name] = _path(events, TEXT_PATHS[name])
        elif name in NUMBER_PATHS:
            added[name] = _path(events, NUMBER_PATHS[name]).try_cast("double")
        elif name in BOOLEAN_PATHS:
            added[name] = _path(events, BOOLEAN_PATHS[name]) == "true"
        elif name in COLUMNS:
            added[name] = F.lit(None).cast("string")
        else:
            raise RuleError(f"unknown field {name}")
    out = events.withColumns(added) if added else events
    if PER_DOMAIN in names and PER_DOMAIN not in events.columns:
        keys = [k for k in (ANALYSIS, "domain") if k in events.columns]
        counts = events.filter("domain is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias(PER_DOMAIN))
        out = out.join(counts, keys, "left").withColumn(PER_DOMAIN, F.coalesce(PER_DOMAIN, F.lit(0)))
    return out
