"""The event model over the plain ``events`` table: an adapter in expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the adapted events in Spark SQL; ``us`` is microseconds since 1970, free of session time zones.
EVENT_COLUMNS = {
    "id": "event_id",
    "ts": "ts",
    "us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
    "principal": "concat('u', user_id)",
    "src_ip": "concat('10.0.', user_id div 16, '.', user_id % 16)",
    "k": "cast(get_json_object(props, '$.k') as bigint)",
    "domain": "concat('d', cast(get_json_object(props, '$.k') as bigint) % 40, '.example.com')",
    "event_type": "event_type",
    "action": "case when event_type = 'error' then 'blocked' else 'allowed' end",
    "http_method": "case when event_type in ('purchase', 'signup') then 'POST' else 'GET' end",
    "status_code": "case when event_type = 'error' then 403 else 200 end",
    "bytes_out": "cast(round(value * 1000) as bigint)",
    "bytes_in": "cast(round(value * 100) as bigint)",
    "department": "concat('dept', user_id % 6)",
    "url_path": "concat('/', event_type, '/', cast(get_json_object(props, '$.k') as bigint), case when event_type = 'purchase' then '/setup.exe' else '/index.html' end)",
    "ocsf": """named_struct('risk_score', cast(get_json_object(props, '$.k') as bigint) % 101, 'unmapped', named_struct('url_supercategory', if(cast(get_json_object(props, '$.k') as bigint) % 50 = 0, 'Security', 'Business and Economy'),
        'dlp_engine', if(event_type = 'purchase' and user_id % 9 = 0, 'Corporate Confidential', null)), 'malware', if(event_type = 'error' and user_id % 7 = 0, array(named_struct('name', 'Backdoor.Generic.C2')), cast(array() as array<struct<name: string>>)),
        'http_request', named_struct('url', named_struct('category_ids', array(element_at(array('Web-based Productivity Apps', 'Miscellaneous or Unknown', 'Proxy Avoidance and Anonymizers'), cast(cast(get_json_object(props, '$.k') as bigint) % 3 + 1 as int))))))""",
    "enrichment": "to_json(named_struct('domain', named_struct('newly_registered', user_id % 11 = 0), 'user_agent', named_struct('is_automation_tool', event_type = 'signup')))",
    "user_agent": "case when event_type = 'error' then 'curl/8.0' else 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0' end",
}

#: The same rows in DuckDB, as the common table expression that every oracle begins with.
EVENTS_SQL = """
ev AS (
  SELECT event_id AS id, ts, epoch_us(ts) AS us, 'u' || user_id AS principal,
         '10.0.' || (user_id // 16) || '.' || (user_id % 16) AS src_ip, k,
         'd' || (k % 40) || '.example.com' AS domain, event_type,
         CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'allowed' END AS action,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS http_method,
         CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS status_code,
         CAST(round(value * 1000) AS BIGINT) AS bytes_out, CAST(round(value * 100) AS BIGINT) AS bytes_in,
         'dept' || (user_id % 6) AS department,
         '/' || event_type || '/' || k || CASE WHEN event_type = 'purchase' THEN '/setup.exe' ELSE '/index.html' END AS url_path,
         CASE WHEN event_type = 'error' THEN 'curl/8.0' ELSE 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0' END AS user_agent,
         k % 101 AS risk_score, CASE WHEN k % 50 = 0 THEN 'Security' ELSE 'Business and Economy' END AS url_supercategory,
         CASE WHEN event_type = 'purchase' AND user_id % 9 = 0 THEN 'Corporate Confidential' END AS dlp_engine,
         CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN 'Backdoor.Generic.C2' END AS threat_name,
         CASE k % 3 WHEN 0 THEN 'Web-based Productivity Apps' WHEN 1 THEN 'Miscellaneous or Unknown' ELSE 'Proxy Avoidance and Anonymizers' END AS url_category,
         user_id % 11 = 0 AS newly_registered, event_type = 'signup' AS is_automation_tool
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def carried(src_ip: Column) -> Column:
    """The address that an event's ``src_ip`` counts to: from user 4096 on its third part passes 255 and is carried into the second."""
    part = lambda i: F.element_at(F.split(src_ip, r"\."), i).cast("long")
    return F.concat_ws(".", part(1), part(2) + F.shiftright(part(3), 8), F.pmod(part(3), F.lit(256)), part(4))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies, whatever folder the driver was started in."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The adapted events, only the named columns if any are named, else all but the nested ones."""
    wanted = names or tuple(c for c in EVENT_COLUMNS if c not in ("ocsf", "enrichment"))
    return table(spark, sf_dir, "events").select(*[F.expr(EVENT_COLUMNS[n]).alias(n) for n in wanted])
