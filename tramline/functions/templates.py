"""Template expressions, compiled on the driver to columns that Catalyst plans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = re.compile(r"\{\{((?:[^{}]|\{\{[^{}]*\}\})*)\}\}")
CALL = re.compile(r"\s*(\w+)\s*(?:\((.*)\))?\s*$", re.S)


def split_top(text: str, by: str) -> list[str]:
    """Parts between separators that stand outside parentheses, braces and quotes."""
    out, depth, start, quote, i = [], 0, 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "({":
            depth += 1
        elif c in ")}":
            depth -= 1
        elif not depth and text.startswith(by, i):
            out.append(text[start:i])
            i += len(by)
            start = i
            continue
        i += 1
    return [*out, text[start:]]


def compiled(template: str, context: Column) -> Column:
    """A template over a JSON context. `{{a.b}}` is a path; `|>` applies get(key, default), put(key, value) or integer.
    A template that is one place gives its value, others a text with all places filled; a missing path is empty in a text."""
    template = template.strip()
    whole = PLACE.fullmatch(template)
    if whole:
        return expression(whole[1], context)
    parts, at = [], 0
    for m in PLACE.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(expression(m[1], context), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def argument(text: str, context: Column) -> Column:
    text = text.strip()
    if PLACE.fullmatch(text):
        return compiled(text, context)
    if re.fullmatch(r"-?\d+", text):
        return F.lit(text)
    return F.lit(text.strip("'\""))


def expression(text: str, context: Column) -> Column:
    path, *steps = split_top(text, "|>")
    value = F.get_json_object(context, "$." + path.strip())
    for step in steps:
        m = CALL.match(step)
        if not m:
            raise ValueError(f"not a function: {step}")
        name, args = m[1], [argument(a, context) for a in split_top(m[2], ",")] if m[2] else []
        if name == "integer":
            value = value.try_cast("long").cast("string")
        elif name == "get":
            value = F.try_element_at(F.from_json(value, "map<string,string>"), args[0])
            value = F.coalesce(value, args[1]) if len(args) > 1 else value
        elif name == "put":
            had = F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>"))
            value = F.to_json(with_entry(had, *args))
        else:
            raise ValueError(f"unknown function: {name}")
    return value


def with_entry(values: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(values, lambda k, _: k != key), F.create_map(key, value))


def variables(template: str) -> list[str]:
    return re.findall(r"\{\{([\w.]+)\}\}", template)


def interpolated(template: str, values: Column, keep_missing: bool = True) -> Column:
    """Each {{key}} of the template from a map column; missing keys stay as they are, or raise."""
    out = F.lit(template)
    for name in dict.fromkeys(variables(template)):
        got = F.try_element_at(values, F.lit(name))
        got = got if keep_missing else F.coalesce(got, F.raise_error(F.lit(f"no value for {name}")).cast("string"))
        out = F.when(got.isNull(), out).otherwise(F.replace(out, F.lit("{{" + name + "}}"), got))
    return out


def resolved(spec: dict, outer: dict | None = None) -> dict:
    """Variables of nested specs folded before planning: inner ones override outer ones, defaults yield to both."""
    scope = dict(spec.get("defaults", {})) | (outer or {}) | dict(spec.get("variables", {}))

    def fill(x):
        if isinstance(x, str):
            whole = re.fullmatch(r"\{\{variables\.(\w+)\}\}", x)
            if whole and whole[1] in scope:
                return fill(scope[whole[1]])
            return re.sub(r"\{\{variables\.(\w+)\}\}", lambda m: str(fill(scope[m[1]])) if m[1] in scope else m[0], x)
        if isinstance(x, list):
            return [fill(y) for y in x]
        if isinstance(x, dict):
            return resolved(x, scope) if "variables" in x or "defaults" in x else {k: fill(v) for k, v in x.items()}
        return x

    return {k: fill(v) for k, v in spec.items() if k not in ("variables", "defaults")}
