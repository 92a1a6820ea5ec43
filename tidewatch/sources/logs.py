"""Raw delimited logs: numbered lines, header binding, typed fields, failures kept, sniffing and dimension files."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web

# The canonical fields with their kinds, in their order; encoded names of some; words of values.
FIELDS = {
    "datetime": "time", "user": "text", "clientip": "text", "serverip": "text", "host": "text", "url": "text", "requestmethod": "text", "status": "long", "requestsize": "long", "responsesize": "long",
    "useragent": "text", "action": "text", "urlcategory": "text", "urlsupercategory": "text", "appname": "text", "appclass": "text", "threatname": "text", "threatcategory": "text", "riskscore": "long", "reason": "text",
    "referer": "text", "dlpengine": "text", "dlpdictionaries": "text", "location": "text", "department": "text", "devicehostname": "text", "devicename": "text", "deviceostype": "text", "deviceosversion": "text", "deviceowner": "text",
    "bypassed_traffic": "flag", "flow_type": "text", "ja4_str": "text", "df_hostname": "text", "df_hosthead": "text", "ssldecrypted": "yes_no", "is_sslselfsigned": "yes_no", "is_sslexpiredca": "yes_no", "is_ssluntrustedca": "fail_pass", "srvcertvalidityperiod": "text",
    "srvocspresult": "text", "sha256": "text", "bamd5": "text", "srcip_country": "text", "dstip_country": "text", "is_src_cntry_risky": "yes_no", "is_dst_cntry_risky": "yes_no", "upload_filename": "text", "upload_filetype": "text", "filetype": "text",
    "unscannabletype": "text", "threatseverity": "text",
}
ENCODED = {
    "user": {"ologin": "obfuscated", "b64login": "base64", "elogin": "hex"},
    "clientip": {"ocip": "obfuscated"},
    "host": {"b64host": "base64", "ehost": "hex"},
    "url": {"b64url": "base64", "eurl": "hex"},
    "useragent": {"b64ua": "base64", "eua": "hex"},
    "urlcategory": {"ourlcat": "obfuscated", "b64urlcat": "base64"},
    "threatname": {"b64threatname": "base64"},
    "referer": {"b64referer": "base64", "ereferer": "hex"},
    "dlpengine": {"odlpeng": "obfuscated"},
    "dlpdictionaries": {"odlpdict": "obfuscated"},
    "location": {"b64location": "base64", "elocation": "hex"},
    "department": {"b64dept": "base64", "edepartment": "hex"},
    "upload_filename": {"b64upload_filename": "base64", "eupload_filename": "hex"},
}
SOURCE, CLASS_UID, CATEGORY_UID = "web_proxy", 4002, 4
METHODS = ("GET", "POST", "PUT", "HEAD", "DELETE", "OPTIONS", "CONNECT", "PATCH")
ACTIONS = ("allowed", "blocked")


@dataclass(frozen=True)
class Header:
    delimiter: str
    names: tuple[str, ...]


def header_of(line: str) -> Header:
    """Tab wins over comma; names lose quotes and case."""
    d = "\t" if "\t" in line else ","
    return Header(d, tuple(n.strip().strip('"').lower() for n in line.rstrip("\r\n").split(d)))


def sniff(lines: list[str]) -> float:
    """How surely these lines are such a log: by the header's names, else by the share of rows with an address and a known word."""
    rows = [x for x in lines if x.strip()]
    if not rows:
        return 0.0
    names = set(header_of(rows[0]).names)
    hits = len(names & (set(FIELDS) | {a for v in ENCODED.values() for a in v}))
    if hits >= 5 and hits * 2 >= len(names):
        return 0.95
    import re

    quad = re.compile(r"^\d{1,3}(\.\d{1,3}){3}$")
    good = 0
    for line in rows[:50]:
        cells = line.split("\t" if "\t" in line else ",")
        known = any(c.strip().upper() in METHODS or c.strip().lower() in ACTIONS for c in cells)
        good += bool(known and any(quad.match(c.strip()) for c in cells[:4]))
    return good / len(rows[:50])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, raw) of a file; blank lines are numbered too.

    Splits are numbered apart by their bytes' order and shifted by the lines before: one count per split
    reaches the driver.
    """
    return _numbered(spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("raw")), "raw", "line_no")


def _numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: the dense number, from 1, of each row in the order of the file."""
    raw = rows.select(F.monotonically_increasing_id().alias("_m"), column).withColumn("_p", F.shiftright("_m", 33))
    counts = raw.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect()  # a row a split
    before = list(zip([r["_p"] for r in counts], itertools.accumulate([r["n"] for r in counts], initial=0), strict=False))
    shifts = raw.sparkSession.createDataFrame(before, "_q long, _before long")
    placed = raw.join(F.broadcast(shifts), F.col("_p") == F.col("_q"))
    return placed.select((F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).alias(name), column)


def _at(header: Header, cells: dict[str, Column], name: str) -> Column:
    return cells[name] if name in header.names else F.lit(None).cast("string")


def _decoded(header: Header, cells: dict[str, Column], name: str) -> tuple[Column, Column, Column]:
    """A field's text, whether it came in a form that cannot be read, and whether its code is broken.

    The plain column wins, then the encoded ones in their order.
    """
    value, hidden, broken, open_ = _at(header, cells, name), F.lit(False), F.lit(False), _at(header, cells, name).isNull()
    for alias, how in ENCODED.get(name, {}).items():
        raw = _at(header, cells, alias)
        here = open_ & raw.isNotNull()
        if how == "obfuscated":
            hidden = hidden | here
        else:
            text = web.from_base64(raw) if how == "base64" else web.from_hex(raw)
            value, broken = F.when(here, text).otherwise(value), broken | (here & text.isNull())
        open_ = open_ & raw.isNull()
    return value, hidden, broken


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each made once a row: a filter on what is made of them stays above, so that it doesn't make them again."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return rows.select("*", made).select(*rows.columns, "_made.*")


def _typed(x: Column, kind: str) -> Column:
    low = F.lower(x)
    kinds = {
        "time": lambda: web.as_time(x), "long": lambda: web.as_long(x), "flag": lambda: web.as_long(x) != 0,
        "yes_no": lambda: F.when(low == "yes", F.lit(True)).when(low == "no", F.lit(False)), "fail_pass": lambda: F.when(low == "fail", F.lit(True)).when(low == "pass", F.lit(False)),
    }
    return kinds.get(kind, lambda: x)()


def document(v: dict[str, Column], hidden: Column, line_no: Column) -> Column:
    """The nested document of a line by its typed fields; a part of which nothing is known is null."""
    known = lambda parts, *names: F.when(F.coalesce(*[v[n].cast("string") for n in names]).isNotNull(), parts)
    some = lambda **names: F.struct(*[v[n].alias(k) for k, n in names.items()])
    one = lambda x: F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x))
    low = F.lower(v["action"])
    disposition = F.when(low.isin(*ACTIONS), low).otherwise(F.lit("other"))
    level = F.when(v["status"].between(100, 599), F.concat(F.floor(v["status"] / 100).cast("string"), F.lit("xx"))).otherwise(F.lit("unknown"))
    key = F.concat_ws(":", F.coalesce(v["requestmethod"], F.lit("UNKNOWN")), F.coalesce(v["urlcategory"], F.lit("unknown")), disposition, level)
    malware = F.when(v["threatname"].isNull(), F.array().cast("array<struct<name: string, classification_ids: array<string>>>")).otherwise(F.array(F.struct(v["threatname"].alias("name"), one(v["threatcategory"]).alias("classification_ids"))))
    certificate = ("is_sslselfsigned", "is_sslexpiredca", "is_ssluntrustedca", "srvcertvalidityperiod", "srvocspresult")
    os = known(F.struct(web.os_type(v["deviceostype"]).alias("type"), v["deviceosversion"].alias("version")), "deviceostype", "deviceosversion")
    return F.struct(
        F.lit(CLASS_UID).alias("class_uid"), F.lit(CATEGORY_UID).alias("category_uid"), v["action"].alias("activity_name"), v["datetime"].alias("time"), F.lit(SOURCE).alias("source_type"), line_no.alias("line_no"), key.alias("event_key"),
        F.struct(F.struct(v["user"].alias("email_addr"), F.array_compact(F.array(v["location"], v["department"])).alias("groups")).alias("user")).alias("actor"),
        F.struct(v["clientip"].alias("ip"), known(some(country="srcip_country", is_risky="is_src_cntry_risky"), "srcip_country", "is_src_cntry_risky").alias("location")).alias("src_endpoint"),
        F.when(v["serverip"].isNotNull(), F.struct(v["serverip"].alias("ip"), known(some(country="dstip_country", is_risky="is_dst_cntry_risky"), "dstip_country", "is_dst_cntry_risky").alias("location"))).alias("dst_endpoint"),
        known(F.struct(v["devicehostname"].alias("hostname"), v["devicename"].alias("name"), v["deviceowner"].alias("owner"), os.alias("os")), "devicehostname", "devicename", "deviceowner", "deviceostype", "deviceosversion").alias("device"),
        v["bypassed_traffic"].alias("bypassed_traffic"), v["flow_type"].alias("flow_type"), v["df_hostname"].alias("df_hostname"), v["df_hosthead"].alias("df_hosthead"), v["threatseverity"].alias("threat_severity"),
        known(F.struct(v["ja4_str"].alias("ja4_hash"), v["ssldecrypted"].alias("decrypted"), known(some(is_self_signed=certificate[0], is_expired=certificate[1], is_untrusted_ca=certificate[2], validity_period=certificate[3], ocsp_status=certificate[4]), *certificate).alias("certificate")), "ja4_str", "ssldecrypted", *certificate).alias("tls"),
        known(some(name="upload_filename", upload_type="upload_filetype", download_type="filetype", unscannable_type="unscannabletype", hash_sha256="sha256", hash_md5="bamd5"), "upload_filename", "upload_filetype", "filetype", "unscannabletype", "sha256", "bamd5").alias("file"),
        F.struct(F.struct(v["host"].alias("hostname"), v["url"].alias("path"), one(v["urlcategory"]).alias("category_ids")).alias("url"), v["requestmethod"].alias("http_method"), v["useragent"].alias("user_agent"), v["referer"].alias("referrer")).alias("http_request"),
        known(some(code="status"), "status").alias("http_response"), some(bytes_out="requestsize", bytes_in="responsesize").alias("traffic"), disposition.alias("disposition"), v["riskscore"].alias("risk_score"), malware.alias("malware"),
        F.struct(*[v[n].alias(k) for k, n in (("url_supercategory", "urlsupercategory"), ("app_name", "appname"), ("app_class", "appclass"), ("block_reason", "reason"), ("dlp_engine", "dlpengine"), ("dlp_dictionaries", "dlpdictionaries"), ("location", "location"), ("department", "department"))], hidden.alias("obfuscated_fields")).alias("unmapped"),
    )


def parsed(rows: DataFrame, header: Header) -> DataFrame:
    """(line_no, other columns, event, ocsf, failure): event and its nested document, or a failure; blank lines and the header are left out.

    A failure says why and shows 200 characters; short rows have nulls for what they lack.  A field that came
    obfuscated is null and named in the document.
    """
    known = {n: i for i, n in reversed(list(enumerate(header.names)))}  # of equal names the first counts
    known = {n: i for n, i in known.items() if n in FIELDS or any(n in ENCODED[f] for f in ENCODED)}
    own = [c for c in rows.columns if c not in ("line_no", "raw")]
    body = _once(rows.filter((F.trim("raw") != "") & (F.col("line_no") > 1)), _cells=F.split("raw", header.delimiter, -1))
    body = _once(body, _few=F.size("_cells") < 2, **{f"_c{i}": web.cleaned(F.get("_cells", F.lit(i))) for i in known.values()}).drop("_cells")
    texts = {n: _decoded(header, {c: F.col(f"_c{i}") for c, i in known.items()}, n) for n in FIELDS}
    found = {n for n in FIELDS if {n, *ENCODED.get(n, {})} & set(known)}  # others are null in every line
    kept = {f"_t_{n}": texts[n][0] for n in found} | {f"_h_{n}": texts[n][1] for n in found & set(ENCODED)} | {f"_b_{n}": texts[n][2] for n in found & set(ENCODED)}
    body = _once(body, **kept).drop(*[f"_c{i}" for i in known.values()]) if kept else body
    body = _once(body, **{f"_v_{n}": _typed(F.col(f"_t_{n}"), FIELDS[n]) for n in found}) if found else body
    values = {n: F.col(f"_v_{n}") if n in found else _typed(texts[n][0], FIELDS[n]) for n in FIELDS}
    hidden = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_h_{n}") if n in found else F.lit(False), F.lit(n)) for n in ENCODED])))
    time = F.col("_t_datetime") if "datetime" in found else F.lit(None)
    reason = F.when(F.col("_few"), F.lit("too few fields")).when(time.isNull(), F.lit("no datetime")).when(values["datetime"].isNull(), F.lit("bad datetime"))
    for n in (n for n in ENCODED if n in found):
        reason = reason.when(F.col(f"_b_{n}"), F.lit(f"bad code of {n}"))
    host = F.coalesce(values["host"], web.host_of(values["url"]))
    body = _once(body, _reason=reason.otherwise(F.lit(None).cast("string")), _host=host, _path=web.path_of(values["url"]), _hidden=hidden)
    body = _once(body, _domain=web.registrable_domain(F.col("_host")))
    event = F.struct(*[v.alias(n) for n, v in values.items() if n != "host"], F.col("_host").alias("host"), F.col("_path").alias("url_path"), F.col("_domain").alias("registrable_domain"))
    right = F.col("_reason").isNull()
    return body.select("line_no", *own, F.when(right, event).alias("event"), F.when(right, document(values, F.col("_hidden"), F.col("line_no"))).alias("ocsf"), F.when(~right, F.struct(F.col("_reason").alias("reason"), F.substring("raw", 1, 200).alias("excerpt"))).alias("failure"))


def rule_events(rows: DataFrame) -> DataFrame:
    """The columns that rules and detectors read, of parsed lines without a failure; ``id`` is the line's number."""
    e = rows.filter("event is not null")
    return e.select(
        F.col("line_no").alias("id"), F.unix_micros("event.datetime").alias("us"), F.col("event.user").alias("principal"), F.col("event.clientip").alias("src_ip"), F.col("event.serverip").alias("dst_ip"), F.col("event.host").alias("domain"), F.col("event.url_path").alias("url_path"),
        F.col("ocsf.disposition").alias("action"), F.col("event.requestmethod").alias("http_method"), F.col("event.status").alias("status_code"), F.col("event.requestsize").alias("bytes_out"), F.col("event.responsesize").alias("bytes_in"), F.col("event.useragent").alias("user_agent"), F.col("event.department").alias("department"), F.col("ocsf.event_key").alias("event_key"), "ocsf",
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log with a header line, parsed."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    return parsed(lines(spark, path), header_of(first[0]))


def statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("event").alias("events"), F.count("failure").alias("failed"), F.coalesce(F.count("failure") / F.count(F.lit(1)), F.lit(0.0)).alias("failure_rate"))


def failures(rows: DataFrame) -> DataFrame:
    return rows.filter("failure is not null").select("line_no", "failure.*")


def ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, asn, org, country, is_hosting) from rows of CIDR blocks."""
    rows = spark.read.csv(path, header=True)
    net = F.split("cidr", "/")
    bits = F.element_at(net, 2).try_cast("int")
    start = web.ip_number(F.element_at(net, 1))
    return rows.select(start.alias("start"), (start + F.pow(F.lit(2.0), 32 - bits).cast("long") - 1).alias("end"), F.col("asn").cast("int").alias("asn"), "org", "country", web.as_boolean(F.col("is_hosting")).alias("is_hosting")).filter("start is not null")


def ranked_list(spark: SparkSession, path: str) -> DataFrame:
    """(domain, rank) of a text file with one domain a line; # begins a comment."""
    text = spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("raw")).filter("raw <> ''")
    return _numbered(text, "raw", "rank").select(F.col("raw").alias("domain"), F.col("rank").cast("int").alias("rank"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, line_no) of ground-truth files."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("scenarios").alias("s"))
    return rows.select(F.col("s.scenario_id").alias("scenario_id"), F.explode("s.malicious_line_numbers").alias("line_no"))


# -- historical baselines --------------------------------------------------------------------------------------


def baseline_windows(spark: SparkSession, path: str) -> DataFrame:
    """(entity_type, entity_value, metric, window_start, value) from files with a window of several metrics a line."""
    rows = spark.read.json(path)
    metrics = [f.name for f in rows.schema["metrics"].dataType.fields]
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"metrics.{m}").cast("double").alias("value")) for m in metrics])
    return rows.select("entity_type", "entity_value", F.col("window_start").cast("timestamp").alias("window_start"), F.explode(each).alias("x")).select("entity_type", "entity_value", "window_start", "x.metric", "x.value").filter("value is not null")


def baseline_profiles(spark: SparkSession, path: str, schema: str = "p50 double, p95 double, p99 double, mean double, mad double, n_windows long") -> DataFrame:
    """(entity_type, entity_value, metric and the profile's numbers) from one document: type, value, metric, profile."""
    kind = f"map<string, map<string, map<string, struct<{schema.replace(' double', ': double').replace(' long', ': long')}>>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d"))
    out = text.select(F.explode("d").alias("entity_type", "a")).select("entity_type", F.explode("a").alias("entity_value", "b")).select("entity_type", "entity_value", F.explode("b").alias("metric", "p"))
    return out.select("entity_type", "entity_value", "metric", "p.*")


def baseline_contacts(spark: SparkSession, path: str) -> DataFrame:
    """(scope, scope_value, domain, contact_count, first_seen, last_seen) from a list of records."""
    rows = spark.read.json(path, multiLine=True)
    return rows.select("scope", "scope_value", "domain", F.col("contact_count").cast("long").alias("contact_count"), F.col("first_seen").cast("timestamp").alias("first_seen"), F.col("last_seen").cast("timestamp").alias("last_seen"))
