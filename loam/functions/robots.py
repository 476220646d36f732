"""Robots rules: parsing and matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as ty

Group = tuple[str, list[str], list[str]]  # agent, allowed, disallowed


def parse_robots(body: str) -> list[Group]:
    """Every agent line begins a group of its own; comments and empty values are ignored."""
    groups: list[Group] = []
    for line in body.splitlines():
        key, colon, value = line.split("#", 1)[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            groups.append((value.lower(), [], []))
        elif groups and value and key in ("allow", "disallow"):
            groups[-1][1 if key == "allow" else 2].append(value)
    return groups


def matches(path: str, pattern: str) -> bool:
    """/ fits all; one star means prefix and suffix; a final $ means the exact path; else a prefix."""
    if pattern == "/":
        return True
    if pattern.count("*") == 1:
        before, after = pattern.split("*")
        return path.startswith(before) and path.endswith(after.removesuffix("$"))
    return path == pattern[:-1] if pattern.endswith("$") else path.startswith(pattern)


def is_allowed(groups: list[Group], path: str, agent: str) -> bool:
    """Groups whose agent is part of the given one, else those of *; any fitting allow wins over disallows; no rules, no ban."""
    agent = agent.lower()
    mine = [g for g in groups if g[0] != "*" and g[0] in agent] or [g for g in groups if g[0] == "*"]
    for _, allowed, banned in mine:
        if any(matches(path, p) for p in allowed):
            return True
        if any(matches(path, p) for p in banned):
            return False
    return True


@F.pandas_udf(ty.BooleanType())
def robots_allowed(body: pd.Series, path: pd.Series, agent: pd.Series) -> pd.Series:
    """A missing robots file allows everything."""
    parsed = {b: parse_robots(b) for b in body.dropna().unique()}
    return pd.Series([True if b is None or b != b else is_allowed(parsed[b], p, a) for b, p, a in zip(body, path, agent)])
