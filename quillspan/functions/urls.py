"""Addresses: normal form, keys, hosts, registrable domains and crawler traps.

Column expressions serve plans over many rows; the Python functions give the same
results for single addresses and for what only a URL parser can do (resolving).
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_URL_BYTES, MAX_DEPTH, MAX_PER_HOST, MAX_SEGMENTS, MAX_PARAMS, MAX_SEGMENT_REPEATS = 2048, 4, 5000, 12, 4, 3

# Query parameters that only track visits.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_source_platform gclid gclsrc dclid fbclid msclkid yclid twclid igshid mc_cid mc_eid _ga _gl hsa_cam hsa_grp vero_id wickedid mkt_tok".split()
# Query parameters that carry a session.
SESSIONS = "phpsessid jsessionid aspsessionid asp.net_sessionid sessionid session_id sid sessid cfid cftoken zenid oscsid".split()
# Extensions of what is no page.
SKIPPED_EXTENSIONS = "jpg jpeg png gif webp avif svg ico bmp tiff mp3 mp4 m4a m4v avi mov wmv flv webm ogg wav zip gz bz2 xz 7z rar tar exe dmg iso msi deb rpm apk woff woff2 ttf otf eot css js mjs json xml rss atom doc docx xls xlsx ppt pptx psd ai eps dwg bin dat swf".split()
#: Suffix rules for tests and small runs; a full public list is read with :func:`suffix_rules`.
SUFFIXES = "com org net co.uk org.uk com.au github.io *.ck !www.ck".split()


def host_raw(url: Column) -> Column:
    """Host as written: without scheme, user and port."""
    return F.regexp_extract(url, r"^(?:[^:/?#]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)


def host_node(url: Column) -> Column:
    """Host as a node of the graph: lower case, no closing dot, no leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(host_raw(url)), r"\.$", ""), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def pairs_of(url: Column) -> Column:
    """Query pairs as 'name=value' texts, in order."""
    pairs = F.filter(F.split(query_of(url), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))


def admissible(url: Column) -> Column:
    return url.rlike(r"^(?i:https?)://") & (host_raw(url) != "") & (F.octet_length(url) <= MAX_URL_BYTES)


def normal_url(url: Column) -> Column:
    """Fragment, default port and tracking or session parameters dropped, order kept; null where inadmissible."""
    dropped = F.array(*map(F.lit, TRACKING + SESSIONS))
    kept = F.filter(pairs_of(url), lambda p: ~F.array_contains(dropped, F.lower(F.substring_index(p, "=", 1))))
    scheme = F.lower(F.regexp_extract(url, r"^([^:/?#]*)://", 1))
    authority = F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, r":80$", "")).otherwise(F.regexp_replace(authority, r":443$", ""))
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    out = F.concat(scheme, F.lit("://"), authority, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(admissible(url) & (F.octet_length(out) <= MAX_URL_BYTES), out)


def dedupe_key(url: Column) -> Column:
    """Key of an address: lower host, path without its last slash, sorted pairs; no scheme and no port."""
    path = path_of(url)
    short = F.when(path.rlike(r"^.+/$"), F.regexp_replace(path, r"/$", "")).otherwise(path)
    pairs = F.array_sort(pairs_of(url))
    return F.concat(F.lower(host_raw(url)), short, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))


def trap(url: Column, depth: Column, fetched_of_host: Column, max_depth: int = MAX_DEPTH, max_per_host: int | None = MAX_PER_HOST) -> Column:
    """The first trap that refuses an address, or null. No max_per_host: no quota."""
    full = F.lit(False) if max_per_host is None else fetched_of_host >= max_per_host
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    params = F.filter(F.split(query_of(url), "&"), lambda p: p != "")
    extension = F.lower(F.regexp_extract(path_of(url), r"\.([^./]*)/*$", 1))
    repeats = F.exists(segments, lambda s: (F.octet_length(s) >= 2) & (F.size(F.filter(segments, lambda o: o == s)) > MAX_SEGMENT_REPEATS))
    year = F.exists(segments, lambda s: s.rlike(r"^[0-9]{4}$") & ~s.cast("int").between(1990, 2100))
    return (
        F.when(depth > max_depth, "depth")
        .when(full, "host quota")
        .when(F.size(segments) > MAX_SEGMENTS, "segments")
        .when(F.size(params) > MAX_PARAMS, "parameters")
        .when(extension.isin(SKIPPED_EXTENSIONS), "extension")
        .when(repeats, "repetition")
        .when(year, "date")
    )


def normalise(url: str) -> str | None:
    """:func:`normal_url` of one address."""
    try:
        u = urlsplit(url.strip())
        port = u.port
    except ValueError:
        return None
    if u.scheme.lower() not in ("http", "https") or not u.hostname:
        return None
    host = u.hostname if port is None or port == {"http": 80, "https": 443}[u.scheme.lower()] else f"{u.hostname}:{port}"
    kept = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING and k.lower() not in SESSIONS]
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in kept)
    out = f"{u.scheme.lower()}://{host}{u.path or '/'}" + (f"?{query}" if query else "")
    return out if len(out.encode()) <= MAX_URL_BYTES else None


def resolve(base: str, href: str) -> str | None:
    """Absolute normal form of a link, or null for fragments, blanks and other schemes."""
    href = href.strip()
    if not href or href[0] == "#":
        return None
    try:
        return normalise(urljoin(base, href))
    except ValueError:
        return None


def suffix_rules(path: str | None = None) -> frozenset[str]:
    """Rules of a public suffix list file ('//' begins a comment), or the small built-in set."""
    if path is None:
        return frozenset(SUFFIXES)
    with open(path, encoding="utf-8") as f:
        return frozenset(x for line in f if (x := line.split("//")[0].strip().lower()))


def registrable(host: str | None, rules: frozenset[str] = frozenset(SUFFIXES)) -> str | None:
    """The part of a host that one owner registers. An exception beats the longest rule; without rule the last label is the suffix."""
    if host is None:
        return None
    host = host.lower().rstrip(".")
    if re.fullmatch(r"[0-9.]+|\[?[0-9a-f:]+:[0-9a-f:.]*\]?", host):
        return host
    labels = host.split(".")
    suffix = 1
    for i in range(len(labels)):
        rest = ".".join(labels[i:])
        if "!" + rest in rules:
            suffix = len(labels) - i - 1
            break
        if rest in rules or (i + 1 < len(labels) and "*." + ".".join(labels[i + 1 :]) in rules):
            suffix = len(labels) - i
            break
    return ".".join(labels[-(suffix + 1) :]) if len(labels) > suffix else host


def site_udf(rules: frozenset[str] = frozenset(SUFFIXES)):
    """:func:`registrable` as a vectorised function; put it over distinct hosts."""

    @F.pandas_udf("string")
    def site(hosts: pd.Series) -> pd.Series:
        return hosts.map(lambda h: registrable(h, rules))

    return site
