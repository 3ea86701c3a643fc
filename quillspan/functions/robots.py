"""robots.txt: parsing, group choice, matching and verdicts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DELAY, DEFAULT_RETRY = 3600.0, 60


def parse(body: str) -> dict:
    """{'groups': [{'agents', 'rules': [(allow, pattern)], 'delay'}], 'sitemaps'}. Agents that follow one another share a group."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    naming = False
    for line in body.lstrip("﻿").splitlines():
        name, colon, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "sitemap":
            if value:
                sitemaps.append(value)
            continue
        if name == "user-agent":
            if not naming:
                groups.append({"agents": [], "rules": [], "delay": None})
            groups[-1]["agents"].append(value.lower())
            naming = True
            continue
        naming = False
        if not groups:
            continue
        if name in ("allow", "disallow"):
            if value:
                groups[-1]["rules"].append((name == "allow", value))
        elif name == "crawl-delay":
            try:
                delay = float(value)
            except ValueError:
                continue
            if delay >= 0:
                groups[-1]["delay"] = min(delay, MOST_DELAY)
    return {"groups": groups, "sitemaps": sitemaps}


def group_for(robots: dict, agent: str) -> dict | None:
    """The group of the longest agent name that our token begins with; * is weakest."""
    best, size = None, -1
    for g in robots["groups"]:
        for a in g["agents"]:
            n = 0 if a == "*" else len(a) if a and agent.lower().startswith(a) else -1
            if n > size:
                best, size = g, n
    return best


def to_regex(pattern: str) -> str:
    """* is any run; a closing $ is the end of the path."""
    end = pattern.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in pattern[: -1 if end else None].split("*")) + ("$" if end else "")


def allows(robots: dict, agent: str, path: str) -> bool:
    """The longest pattern that matches decides; Allow wins ties."""
    group = group_for(robots, agent)
    if group is None:
        return True
    best = (-1, True)
    for allow, pattern in group["rules"]:
        if re.match(to_regex(pattern), path, re.DOTALL):
            best = max(best, (len(pattern), allow))
    return best[1]


def allowed(agent: str):
    """allows(robots text, path) as a vectorised function; each distinct robots text of a batch is parsed once."""

    @F.pandas_udf("boolean")
    def run(bodies: pd.Series, paths: pd.Series) -> pd.Series:
        known = {b: parse(b) for b in bodies.dropna().unique()}
        return pd.Series([b is None or allows(known[b], agent, p or "/") for b, p in zip(bodies, paths)], dtype=bool)

    return run


def delays(agent: str):
    """Seconds that the group for an agent asks to wait between requests, 0 where it asks for none."""

    @F.pandas_udf("double")
    def run(bodies: pd.Series) -> pd.Series:
        known = {b: (group_for(parse(b), agent) or {}).get("delay") or 0.0 for b in bodies.dropna().unique()}
        return bodies.map(known).fillna(0.0).astype(float)

    return run


def verdict(status: Column) -> Column:
    """What a robots.txt answer means: its rules, everything open, or everything closed."""
    return F.when(status.between(200, 299), "rules").when(status.isin(401, 403), "closed").when(status.between(400, 499), "open").otherwise("closed")


def retry_after(header: Column) -> Column:
    return F.least(F.coalesce(header.try_cast("int"), F.lit(DEFAULT_RETRY)), F.lit(int(MOST_DELAY)))
