"""Closed JSON schemas over a column of JSON texts."""

import datetime as dt
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.functions.canonical import strict_value

KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def _date(v: str) -> bool:
    try:
        return dt.date.fromisoformat(v).isoformat() == v
    except ValueError:
        return False


def _same(a, b) -> bool:
    """JSON equality: 1 equals 1.0, but true does not equal 1."""
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) or KINDS["number"](a) and KINDS["number"](b) and a == b


def violations(value, schema: dict, root: dict | None = None, path: str = "$"):
    """(path, keyword) of every rule that a value breaks.

    Keywords: type, const, enum, pattern (searched), minLength, maxLength, minimum, maximum, minItems, maxItems, uniqueItems,
    items, required, properties, additionalProperties false, format date, allOf, anyOf, oneOf, not, if/then/else and $ref
    within the schema. Any other keyword is refused rather than passed over.
    """
    root = root or schema
    for word, rule in schema.items():
        if word in ("$schema", "$id", "$defs", "definitions", "title", "description", "properties", "additionalProperties", "then", "else", "$comment", "default", "examples"):
            continue
        ok = True
        if word == "type":
            ok = any(KINDS[k](value) for k in ([rule] if isinstance(rule, str) else rule))
        elif word == "const":
            ok = _same(value, rule)
        elif word == "enum":
            ok = any(_same(value, r) for r in rule)
        elif word in ("pattern", "minLength", "maxLength", "format"):
            if isinstance(value, str):
                ok = {"pattern": lambda: re.search(rule, value) is not None, "minLength": lambda: len(value) >= rule, "maxLength": lambda: len(value) <= rule, "format": lambda: rule != "date" or _date(value)}[word]()
        elif word in ("minimum", "maximum"):
            ok = not KINDS["number"](value) or (value >= rule if word == "minimum" else value <= rule)
        elif word in ("minItems", "maxItems"):
            ok = not isinstance(value, list) or (len(value) >= rule if word == "minItems" else len(value) <= rule)
        elif word == "uniqueItems":
            ok = not isinstance(value, list) or not rule or len({json.dumps(v, sort_keys=True) for v in value}) == len(value)
        elif word == "required":
            ok = not isinstance(value, dict) or all(k in value for k in rule)
        elif word == "items":
            for i, v in enumerate(value if isinstance(value, list) else ()):
                yield from violations(v, rule, root, f"{path}[{i}]")
        elif word == "$ref":
            target = root
            for step in rule.removeprefix("#/").split("/"):
                target = target[step]
            yield from violations(value, target, root, path)
        elif word == "allOf":
            for r in rule:
                yield from violations(value, r, root, path)
        elif word in ("anyOf", "oneOf"):
            n = sum(not any(violations(value, r, root, path)) for r in rule)
            ok = n >= 1 if word == "anyOf" else n == 1
        elif word == "not":
            ok = any(violations(value, rule, root, path))
        elif word == "if":
            branch = schema.get("else" if any(violations(value, rule, root, path)) else "then", {})
            yield from violations(value, branch, root, path)
        else:
            raise ValueError(f"unknown keyword {word}")
        if not ok:
            yield path, word
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k, v in value.items():
            if k in known:
                yield from violations(v, known[k], root, f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{path}.{k}", "additionalProperties"
            elif isinstance(schema.get("additionalProperties"), dict):
                yield from violations(v, schema["additionalProperties"], root, f"{path}.{k}")


def schema_findings(rows: DataFrame, schema: dict, *, record_id: str = "record_id", text: str = "text") -> DataFrame:
    """(record_id, path, keyword): one finding per path a record breaks the schema at, the least keyword of each.

    A text that is null or no JSON breaks it at $ as ``json``, as do repeated keys, NaN and the like, and too deep nesting.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                value, code = strict_value(r.text)
                found = [("$", "json")] if code else sorted(set(violations(value, schema)), key=lambda f: (re.split(r"[.\[\]]+", f[0]), f[1]))
                seen = set()
                for path, word in found:
                    if path not in seen:
                        seen.add(path)
                        out.append((r.record_id, path, word))
            yield pd.DataFrame(out, columns=["record_id", "path", "keyword"])

    return rows.select(F.col(record_id).cast("string").alias("record_id"), F.col(text).alias("text")).mapInPandas(run, "record_id string, path string, keyword string")
