"""Lenient JSON extraction from model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSIFICATION = "categories array<int>, confidence double"


def braces(c: Column) -> Column:
    """From the first { to the last }; empty without them."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def extract_json(c: Column) -> Column:
    """The response's JSON: what the last ```json fence holds if there is one, cut to its
    outer braces; as it is if it parses, else with line breaks and runs of white space
    collapsed; the stripped response if neither parses."""
    inner = F.element_at(F.split(c, "```json"), -1)
    inner = F.when(F.contains(c, F.lit("```json")), F.element_at(F.split(inner, "```"), 1)).otherwise(c)
    cut = braces(inner)
    flat = F.regexp_replace(cut, r"\s+", " ")
    parses = lambda x: (x != "") & F.try_parse_json(x).isNotNull()
    return F.when(parses(cut), cut).when(parses(flat), flat).otherwise(F.trim(inner))


def first_object(c: Column) -> Column:
    """The first balanced object (two levels deep) that parses; null without one."""
    found = F.regexp_extract_all(c, F.lit(r"(\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\})"), 1)  # possessive: texts of any length need no stack
    return F.get(F.filter(found, lambda x: F.try_parse_json(x).isNotNull()), 0)


def parse_classification(c: Column) -> Column:
    """struct(categories, confidence): the JSON's, else the first three numbers at 0.7,
    else no category at 0."""
    from .text import first_numbers

    got = F.from_json(braces(c), CLASSIFICATION)
    numbers = F.transform(first_numbers(c), lambda x: x.cast("int"))
    usable = got["categories"].isNotNull()
    return F.struct(
        F.when(usable, got["categories"]).otherwise(F.coalesce(numbers, F.array().cast("array<int>"))).alias("categories"),
        F.when(usable, F.coalesce(got["confidence"], F.lit(0.0))).when(c.isNull(), 0.0).otherwise(0.7).alias("confidence"),
    )


def array_length(c: Column) -> Column:
    """Elements of a JSON array; null if it isn't one."""
    return F.json_array_length(c)


def canonical(columns: dict[str, Column]) -> Column:
    """One text for equal values, for keys: fields in the order of their names, nulls too."""
    return F.to_json(F.struct(*(columns[name].alias(name) for name in sorted(columns))), {"ignoreNullFields": "false"})


def batch_items(c: Column) -> Column:
    """Items of a batch's response that have a ticket_id, categories and a summary."""
    cut = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    rows = F.from_json(cut, "array<struct<ticket_id:string,categorias:array<string>,resumo:string>>")
    return F.filter(rows, lambda x: x["ticket_id"].isNotNull() & (F.size(x["categorias"]) > 0) & (F.length(x["resumo"]) > 0))


def bullets_of(c: Column, expected: int = 15) -> Column:
    """struct(bullets, resumo, issues) of a summary response: bullets trimmed, blank ones
    gone; issues name another number than expected, no bullets, or no summary."""
    got = F.from_json(first_object(c), "bullets array<struct<bullet:string>>, resumo string")
    bullets = F.filter(F.transform(F.coalesce(got["bullets"], F.array().cast("array<struct<bullet:string>>")), lambda b: F.trim(b["bullet"])), lambda b: b.isNotNull() & (b != ""))
    resumo = F.trim(F.coalesce(got["resumo"], F.lit("")))
    issues = F.array_compact(F.array(F.when(F.size(bullets) == 0, "no bullets").when(F.size(bullets) != expected, "another number of bullets"), F.when(resumo == "", "no summary")))
    return F.struct(bullets.alias("bullets"), resumo.alias("resumo"), issues.alias("issues"))


def items_of(c: Column) -> Column:
    """Classified items of a response: those with an id and an array, trimmed, three
    categories at most."""
    rows = F.from_json(braces(c), "cat array<struct<id:string,cat:array<string>>>")["cat"]
    good = F.filter(rows, lambda x: x["id"].isNotNull() & x["cat"].isNotNull())
    return F.transform(good, lambda x: F.struct(x["id"].alias("id"), F.slice(F.filter(F.transform(x["cat"], lambda y: F.trim(y)), lambda y: y.isNotNull()), 1, 3).alias("cat")))


def response_issues(c: Column, expected: str) -> Column:
    """What is wrong with a response, `json` or `text`."""
    if expected == "json":
        items = F.from_json(braces(c), "cat array<struct<id:string,cat:array<string>>>")["cat"]
        checks = [
            (items.isNull(), "missing or invalid cat list"),
            (F.exists(items, lambda x: x["id"].isNull() | x["cat"].isNull()), "item without id or cat"),
            (F.exists(items, lambda x: F.size(x["cat"]) > 3), "more than three categories"),
        ]
    else:
        checks = [(F.length(c) < 50, "too short"), (F.length(c) > 5000, "too long")]
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), what) for cond, what in checks)))
