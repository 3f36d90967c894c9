"""Accounts in JSON of any shape: flat lists, groups by period, or companies with rows and values by period, to any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the fields of an account, of the fields that what lies below inherits, and of maps from period to value.
FIELDS = {
    "code": ("CD_CONTA", "COD_CONTA", "ACCOUNT_CODE", "codigo", "codigo_conta", "conta", "code"),
    "description": ("DS_CONTA", "descricao", "descricao_conta", "description"),
    "value": ("VL_CONTA", "valor", "value", "VL"),
}
INHERITED = {
    "period": ("DT_FIM_EXERC", "DT_REFER", "periodo", "data", "date"),
    "start": ("DT_INI_EXERC", "inicio_periodo", "data_inicio"),
    "scope": ("ESCOPO", "scope", "tipo_dre"),
    "kind": ("kind",),
}
VALUE_MAPS = ("values", "valores")
PERIOD_DATES = "period_metadata"
#: Fields whose children's names are a label of everything below them.
KEYED = {"companies": "ticker"}

_CHILD = "array<struct<step:string,name:string,node:variant>>"


def json_depth(text: Column) -> Column:
    """Greatest number of brackets open at once outside quotes; 0 for null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\[\s\S]", ""), r'"[^"]*+"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(a, b):
        now = a["open"] + F.when(b.isin("{", "["), 1).when(b.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(a["most"], now).alias("most"))

    return F.coalesce(F.aggregate(brackets, start, step, lambda a: a["most"]), F.lit(0))


def json_number(node: Column) -> Column:
    """A finite number, or a text in Brazilian or English form (parentheses negate; of two separators the last is decimal); else null."""
    text = F.regexp_replace(F.try_variant_get(node, "$", "string"), "[\\s\u00a0]", "")
    parens, bare = text.rlike(r"^\(.*\)$"), F.regexp_replace(text, r"^[()]+|[()]+$", "")
    comma, dot = F.contains(bare, F.lit(",")), F.contains(bare, F.lit("."))
    dot_last = F.length(F.substring_index(bare, ".", -1)) < F.length(F.substring_index(bare, ",", -1))
    plain = F.when(comma & dot & dot_last, F.replace(bare, F.lit(","), F.lit(""))).when(comma, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
    read = F.when(plain.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    signed = F.when(parens, -read).otherwise(read)
    kind = F.schema_of_variant(node)
    number = F.when(kind == "STRING", signed).when(kind != "BOOLEAN", F.try_variant_get(node, "$", "double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


_MAP = "map<string,variant>"


def _names(names) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in dict.fromkeys(n.upper() for n in names)) + ")"


#: The fields of an object that mean something here, as (NAME in upper case, value); null for anything else.
_FIELDS = f"""filter(transform(map_entries(try_variant_get(node, '$', '{_MAP}')), e -> named_struct('field', upper(e.key), 'node', e.value)),
  e -> array_contains({_names([n for g in (*FIELDS.values(), *INHERITED.values(), VALUE_MAPS, (PERIOD_DATES,)) for n in g])}, e.field))"""


def _nodes(names: tuple[str, ...]) -> str:
    """Values of the fields that are there, in the order of the names; one of a node's equal names in different case."""
    return f"flatten(transform({_names(names)}, n -> slice(filter(fields, e -> e.field = n), 1, 1)))"


def _first(names: tuple[str, ...]) -> str:
    """The first of the fields that is there and not null."""
    return f"try_element_at(filter({_nodes(names)}, e -> not is_variant_null(e.node)), 1).node"


def _text(names: tuple[str, ...]) -> str:
    return f"try_variant_get({_first(names)}, '$', 'string')"


def _map(names: tuple[str, ...]) -> str:
    return f"try_element_at(filter(transform({_nodes(names)}, e -> try_variant_get(e.node, '$', '{_MAP}')), m -> m is not null), 1)"


def flatten_json_records(df: DataFrame, json: str, keep: list[str], depth: int | None = None) -> DataFrame:
    """``keep``, path, ticker, kind, scope, code, description, start, period, value and error of every account in JSON texts.

    A node with a code or description and a value is an account; with a map under ``values`` it is one account for each period
    there. Every other object or list is entered, whatever its name. Period, start, scope, kind and ticker come from the
    node itself or else from the nearest node around it; start and end of a period come from a ``period_metadata`` around it.
    The case of field names does not matter.

    The descent is one narrow pass without a shuffle, as many levels as the deepest text has (``depth``, else measured by one
    aggregate). Accounts without a value go; those without a period have error ``no_period``. Texts that are no JSON give
    one row with ``not_json``; what lies deeper than a given ``depth`` one with ``too_deep``. Null texts and texts
    without an account give no row. Repeated rows and equal accounts stay. A name with a clash is an error of Spark's.
    """
    if depth is None:
        depth = df.agg(F.max(json_depth(F.col(json)))).first()[0] or 0
    labels = [*INHERITED, *KEYED.values()]
    null, no_map = F.lit(None).cast("string"), F.lit(None).cast("map<string,variant>")
    given = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("keep")
    node = F.try_parse_json(json)
    rows = df.filter(F.col(json).isNotNull()).select(
        given, node.alias("node"), F.lit("$").alias("path"), null.alias("name"), no_map.alias("dates"), no_map.alias("cells"), *[null.alias(x) for x in labels],
        null.alias("code"), null.alias("description"), F.when(node.isNull(), "not_json").otherwise("open").alias("state"),
    )
    for _ in range(depth):
        rows = _descend(_judge(rows))
    rows = _judge(rows)
    inner = F.coalesce(F.try_variant_get("node", "$", "map<string,variant>").isNotNull() | F.try_variant_get("node", "$", "array<variant>").isNotNull(), F.lit(False))
    value = F.when(F.col("state") == "account", json_number(F.col("node")))
    error = F.when(F.col("state") == "not_json", "not_json").when(F.col("state") != "account", "too_deep").when(F.col("period").isNull(), "no_period")
    columns = ["path", "ticker", "kind", "scope", "code", "description", "start", "period", "value", "error"]
    found = rows.withColumns({"value": value, "error": error, "inner": inner}).select("keep", F.when((F.col("state") == "account") & F.col("value").isNotNull() | (F.col("state") == "open") & F.col("inner") | (F.col("state").isin("row", "not_json")), F.struct(*columns)).alias("r"))
    out = found.select("keep", F.explode_outer(F.array("r")).alias("r")).filter("r is not null")
    return out.select(*[F.col("keep").getField(c).alias(c) for c in keep], "r.*")


def _judge(rows: DataFrame) -> DataFrame:
    """Labels of open nodes from their own fields; accounts are reduced to their value, rows of accounts to their map of values."""
    own = {n: f"coalesce({_text(names)}, {n})" for n, names in INHERITED.items()}
    own |= {n: f"coalesce(trim({_text(FIELDS[n])}), {n})" for n in ("code", "description")}
    own |= {"dates": f"coalesce({_map((PERIOD_DATES,))}, dates)", "cells": _map(VALUE_MAPS), "has_value": f"size({_nodes(FIELDS['value'])}) > 0", "number": _first(FIELDS["value"])}
    rest = ["keep", "path", "name", *KEYED.values()]
    named = rows.selectExpr("*", f"case when state = 'open' then {_FIELDS} end as fields").selectExpr(*rest, "node", "state as was", *[f"{e} as {n}" for n, e in own.items()])
    labelled = "was = 'open' and coalesce(code, description) is not null"
    judged = named.selectExpr("*", f"case when {labelled} and has_value then 'account' when {labelled} and cells is not null then 'row' else was end as state")
    return judged.selectExpr(
        *rest, *INHERITED, "dates", "cells", "state", "case when state = 'account' and was = 'open' then number else node end as node",
        *[f"case when state <> 'open' then {n} end as {n}" for n in ("code", "description")],
    )


def _descend(rows: DataFrame) -> DataFrame:
    """Children in place of open nodes and rows; everything else as it is."""
    entries = "transform(map_entries({}), e -> named_struct('step', concat('.', e.key), 'name', e.key, 'node', e.value))".format
    items = "transform(try_variant_get(node, '$', 'array<variant>'), (v, i) -> named_struct('step', concat('[', string(i), ']'), 'name', string(null), 'node', v))"
    kids = f"""case state when 'row' then {entries('cells')} when 'open' then coalesce({entries(f"try_variant_get(node, '$', '{_MAP}')")}, {items})
      else array(named_struct('step', '', 'name', name, 'node', node)) end"""
    # explode_outer: explode would add a filter that repeats the whole level's expressions further down
    out = rows.selectExpr("*", f"explode_outer(cast({kids} as {_CHILD})) as kid").filter("kid is not null")
    date = "case when state = 'row' then coalesce(try_variant_get(try_element_at(dates, kid.name), '$.{}', 'string'), {}) else {} end as {}".format
    keyed = [f"case when state = 'open' and name = '{parent}' then kid.name else {label} end as {label}" for parent, label in KEYED.items()]
    same = [n for n in INHERITED if n not in ("period", "start")]
    return out.selectExpr(
        "keep", "concat(path, kid.step) as path", "kid.name as name", "kid.node as node", "dates", "cells", *keyed, *same, date("end_date", "kid.name", "period", "period"),
        date("start_date", "start", "start", "start"), "code", "description", "case when state = 'row' then 'account' else state end as state",
    )
