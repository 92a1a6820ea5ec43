"""Addresses, hosts, URLs, user agents and the text forms of log fields, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes and word lists that results depend on.
DOTTED_QUAD = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
DOWNLOAD = r"(?i)\.(exe|msi|dll|bat|cmd|ps1|vbs|scr|jar|apk|zip|rar|7z|tar\.gz|tgz|tar|gz|iso)(\?|$)"
NULL_WORDS = ("", "none")
TRUE_WORDS, FALSE_WORDS = ("1", "yes", "true", "pass"), ("0", "no", "false", "fail")
TWO_LEVEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
AUTOMATION_AGENTS = ("curl", "wget", "python-requests", "python-urllib", "go-http-client", "java/", "okhttp", "libwww-perl", "powershell", "httpclient", "axios", "node-fetch")
BROWSERS = (("Edge", r"edg(e|a|ios)?/"), ("Opera", r"opr/|opera"), ("Chrome", r"chrome/|crios/"), ("Firefox", r"firefox/|fxios/"), ("Safari", r"version/.*safari/"), ("IE", r"msie |trident/"))
SYSTEMS = (("Windows", r"windows nt"), ("iOS", r"iphone|ipad"), ("Mac OS X", r"mac os x|macintosh"), ("Android", r"android"), ("Linux", r"linux|x11"))
OS_WORDS = (("windows", "^(windows|win)"), ("ios", "^(ios|ipad|iphone)"), ("macos", "^(mac|os x)"), ("android", "^android"), ("chromeos", "^chrom"), ("linux", "^(linux|ubuntu|debian|fedora|red hat|centos)"))
SPECIAL_NETS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("224.0.0.0", 4), ("240.0.0.0", 4))


def cleaned(x: Column) -> Column:
    """Trimmed text; the empty text and "None" are null."""
    t = F.trim(x)
    return F.when(~F.lower(t).isin(*NULL_WORDS), t)


def as_long(x: Column) -> Column:
    """A whole number out of text that may be a decimal; null if it is none."""
    return x.try_cast("double").try_cast("long")


def as_boolean(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))


def as_time(x: Column) -> Column:
    """ISO 8601 with or without fractions, or ``EEE MMM d HH:mm:ss yyyy``."""
    plain = F.regexp_replace(x, "^[A-Za-z]{3} ", "")
    return F.coalesce(F.when(x.rlike(r"^\d{4}-\d\d-\d\dT"), x.try_cast("timestamp")), F.try_to_timestamp(plain, F.lit("MMM d HH:mm:ss yyyy")))


def from_base64(x: Column) -> Column:
    """Strict base64 of UTF-8; null if it is not."""
    raw = F.try_to_binary(x, F.lit("base64"))
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def from_hex(x: Column) -> Column:
    """Text with bytes written as % and two hex digits, of UTF-8; null if it is not."""
    text = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return F.when(F.is_valid_utf8(text) & ~x.rlike("%(?![0-9A-Fa-f]{2})"), text)


def os_type(x: Column) -> Column:
    """An operating system's name as one of a few words; null stays null."""
    low = F.lower(F.trim(x))
    out = F.when(low.isNull(), F.lit(None).cast("string"))
    for word, shape in OS_WORDS:
        out = out.when(low.rlike(shape), F.lit(word))
    return out.otherwise(F.lit("other"))


def is_ipv4(x: Column) -> Column:
    return F.coalesce(x.rlike(DOTTED_QUAD), F.lit(False))


def ip_number(x: Column) -> Column:
    """A dotted quad as a number; null for all else."""
    p = F.split(x, r"\.")
    n = sum((F.element_at(p, i + 1).try_cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(is_ipv4(x), n)


def is_special_number(n: Column) -> Column:
    """Whether an address as a number is private, loopback, shared or reserved."""
    hit = F.lit(False)
    for net, bits in SPECIAL_NETS:
        a, b, c, d = map(int, net.split("."))
        start = ((a * 256 + b) * 256 + c) * 256 + d
        hit = hit | n.between(start, start + 2 ** (32 - bits) - 1)
    return F.coalesce(hit, F.lit(False))


def is_special(x: Column) -> Column:
    return is_special_number(ip_number(x))


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without port or user."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, query included; "/" if nothing does."""
    p = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([/?#].*)?$", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), lambda s: s != "")


def registrable_domain(host: Column) -> Column:
    """The last two labels, three below a two-level public suffix; addresses and single labels stay as they are."""
    low = F.lower(host)
    labels = F.split(low, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(is_ipv4(low) | (F.size(labels) < 2), low).when(two.isin(*TWO_LEVEL_SUFFIXES), three).otherwise(two)


def top_level(host: Column) -> Column:
    return F.when(~is_ipv4(host), F.element_at(F.split(F.lower(host), r"\."), -1))


def has_download(path: Column) -> Column:
    return F.coalesce(path.rlike(DOWNLOAD), F.lit(False))


def is_random_segment(s: Column) -> Column:
    """At least 12 characters, 6 different ones, and all hex or base64-like with both cases."""
    different = F.size(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")))
    mixed = s.rlike("^[A-Za-z0-9+/_=-]+$") & s.rlike("[a-z]") & s.rlike("[A-Z]")
    return (F.char_length(s) >= 12) & (different >= 6) & (s.rlike("^[0-9a-fA-F]+$") | mixed)


def user_agent(x: Column) -> Column:
    """struct(family, is_browser, is_automation_tool, os_type) by keywords."""
    low = F.lower(x)
    tool = F.lit(False)
    for word in AUTOMATION_AGENTS:
        tool = tool | low.contains(word)
    family = F.lit("Other")
    for name, shape in reversed(BROWSERS):
        family = F.when(low.rlike(shape), F.lit(name)).otherwise(family)
    system = F.lit(None).cast("string")
    for name, shape in reversed(SYSTEMS):
        system = F.when(low.rlike(shape), F.lit(name)).otherwise(system)
    tool = F.coalesce(tool, F.lit(False))
    return F.struct(F.when(tool, F.lit("Automation")).otherwise(family).alias("family"), (F.coalesce(family != "Other", F.lit(False)) & ~tool).alias("is_browser"), tool.alias("is_automation_tool"), system.alias("os_type"))
