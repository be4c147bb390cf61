"""Predicate trees compiled to columns: metadata filters, issue filters, issue queries, time expressions."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CONDITIONS, MAX_DEPTH = 200, 8
_KEY = re.compile(r"[a-zA-Z0-9_-]{1,64}")
_COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def all_of(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def any_of(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def metadata_filter(tree: dict[str, Any], column: str = "metadata") -> Column:
    """{"AND": [...]}, {"OR": [...]} or {"key", "value", "filterType", "numericOperator", "ignoreCase", "negate"} over a JSON column.

    A missing key matches nothing, also when negated it counts as not matching before negation.
    """
    seen = 0

    def build(node: dict[str, Any], depth: int) -> Column:
        nonlocal seen
        if depth > MAX_DEPTH:
            raise ValueError(f"deeper than {MAX_DEPTH}")
        for word, join in (("AND", all_of), ("OR", any_of)):
            if word in node:
                return join([build(x, depth + 1) for x in node[word]])
        seen += 1
        if seen > MAX_CONDITIONS:
            raise ValueError(f"more than {MAX_CONDITIONS} conditions")
        if not _KEY.fullmatch(node["key"]):
            raise ValueError(f"bad key {node['key']!r}")
        found, value = F.get_json_object(column, f"$['{node['key']}']"), node["value"]
        kind = node.get("filterType", "metadata")
        if kind == "numeric":
            test = _COMPARE[node.get("numericOperator", "=")](F.expr(f"try_cast(get_json_object({column}, \"$['{node['key']}']\") AS double)"), F.lit(float(value)))
        elif kind == "array_contains":
            test = F.array_contains(F.from_json(found, "array<string>"), str(value))
        elif kind == "string_contains":
            test = F.lower(found).contains(str(value).lower()) if node.get("ignoreCase") else found.contains(str(value))
        else:
            test = found == str(value)
        test = F.coalesce(test, F.lit(False))
        return ~test if node.get("negate") else test

    return build(tree, 1)


def glob_regex(pattern: str, segments: bool = False) -> str:
    """A glob as a regular expression; with segments, * stays inside a path segment and ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if segments and pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if segments and pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += ("[^/]*" if segments else ".*") if c == "*" else ("[^/]" if segments else ".") if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def relative_time(text: str, now: dt.datetime) -> dt.datetime:
    """[+-]n[hdwmy], a date, or an RFC 3339 time; a bare number of units is in the future."""
    if m := re.fullmatch(r"([+-]?)(\d+)([hdwmy])", text.strip()):
        n = int(m[2]) * (-1 if m[1] == "-" else 1)
        if m[3] in "my":
            months = now.year * 12 + now.month - 1 + n * (12 if m[3] == "y" else 1)
            first = now.replace(year=months // 12, month=months % 12 + 1, day=1)
            return first + dt.timedelta(days=now.day - 1)  # days past a month's end run on, as calendar addition does
        return now + n * {"h": dt.timedelta(hours=1), "d": dt.timedelta(days=1), "w": dt.timedelta(weeks=1)}[m[3]]
    found = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return found.astimezone(dt.timezone.utc).replace(tzinfo=None) if found.tzinfo else found


TEXT_FIELDS = {"title", "description", "notes", "assignee", "owner", "id", "spec", "parent", "status", "type", "label"}
FIELDS = {"type": "issue_type", "created": "created_at", "updated": "updated_at", "closed": "closed_at", "due": "due_at", "defer": "defer_until"}
TIMES = {"created", "updated", "closed", "due", "defer"}


def issue_query(tree: dict[str, Any], now: dt.datetime) -> Column:
    """{"and"|"or": [...]}, {"not": x} or {"field", "op", "value"} over issues with a labels array.

    Text matches by substring for title, description and notes, by wildcard for id; `none` means
    empty; durations mean now minus; a date with = spans its day and with <= reaches its end.
    """
    if "and" in tree:
        return all_of([issue_query(x, now) for x in tree["and"]])
    if "or" in tree:
        return any_of([issue_query(x, now) for x in tree["or"]])
    if "not" in tree:
        return ~issue_query(tree["not"], now)
    field, op, value = tree["field"], tree.get("op", "="), tree["value"]
    column = F.col(FIELDS.get(field, field)) if field != "label" else F.col("labels")
    if field == "label":
        test = (F.size("labels") == 0) if value == "none" else F.array_contains("labels", value)
    elif field in TIMES:
        if re.fullmatch(r"\d+[hdwmy]", str(value)):
            test = _COMPARE[op](column, F.lit(relative_time(f"-{value}", now)))
        else:
            start = relative_time(str(value), now)
            end = start + dt.timedelta(days=1) - dt.timedelta(microseconds=1) if len(str(value)) == 10 else start
            test = {
                "=": (column >= F.lit(start)) & (column <= F.lit(end)), "!=": ~((column >= F.lit(start)) & (column <= F.lit(end))),
                "<": column < F.lit(start), "<=": column <= F.lit(end), ">": column > F.lit(end), ">=": column >= F.lit(start),
            }[op]
        return F.coalesce(test, F.lit(False))
    elif field == "priority":
        test = _COMPARE[op](column, F.lit(int(value)))
        return F.coalesce(test, F.lit(False))
    elif isinstance(value, bool):
        test = F.coalesce(column, F.lit(False)) == value
    elif value == "none":
        test = column.isNull() | (column == "")
    elif field in ("title", "description", "notes"):
        test = F.lower(column).contains(str(value).lower())
    elif field in ("id", "spec") and "*" in str(value):
        test = column.rlike(glob_regex(str(value)))
    else:
        test = F.lower(column) == str(value).lower()
    test = F.coalesce(test, F.lit(False))
    return ~test if op == "!=" else test
