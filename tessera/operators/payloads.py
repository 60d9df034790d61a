"""Clean component rows from the JSON that a model wrote, whatever its shape.

A payload is read as VARIANT and walked without a schema: it is unwrapped if none of its
keys is known, keys are brought to one spelling, and aliases are looked up in tables, at the
root and in each component. Values are coerced to the field's type and what was coerced or
dropped is counted; components that repeat under one key are merged. All steps are column
expressions on maps and arrays of VARIANT; one explode gives the components.

Defined results: text without a JSON object, null text and payloads without components give no
rows; lists under several aliases are joined in the table's order; a component is a
string (its name) or an object, others are dropped; one without a name is dropped; of
fields under several aliases the first that isn't empty counts; of components with the same
key the first that has a field gives it, and their interfaces are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

#: Keys of a payload and of what may be around it: fixed values.
ROOT_KEYS = ("solution_title", "executive_summary", "sections", "components", "integrations", "assumptions", "next_steps", "risks", "section_readiness", "structured_model")
WRAPPERS = ("architecture", "solution", "result", "payload")
#: Names of the list of components, and of lists inside it: fixed values.
COMPONENT_LISTS = ("components", "component", "component_model", "component_list", "system_components", "architecture_components", "service_components", "services", "service_model", "modules", "subsystems")
INNER_LISTS = ("items", "entries", "components", "component_list", "component_model", "nodes")
#: A component's fields with their aliases: fixed values.
FIELDS = {
    "component_name": ("component_name", "component_code", "name", "title", "mapping_key"),
    "role_description": ("role_description", "description", "role", "purpose", "responsibility", "details", "summary"),
    "boundary_type": ("boundary_type", "boundary", "layer", "scope"),
    "external_flag": ("external_flag", "is_external", "external"),
    "technology_stack": ("technology_stack", "stack", "technologies"),
    "interfaces": ("interfaces", "interface", "endpoints", "apis"),
}
YES = ("true", "yes", "y", "1", "да")
NO = ("false", "no", "n", "0", "нет")


def snake(key: Column) -> Column:
    """A key in lower case with underscores between its words."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(key, r"(?<=[a-zа-яё0-9])(?=[A-ZА-ЯЁ])", "_")), r"[^a-z0-9а-яё]+", "_"), "^_+|_+$", "")


def _map(v: Column) -> Column:
    """An object's entries under keys of one spelling; of keys that become alike the first in order counts. Null for others."""
    entries = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string, variant>")), lambda e: F.struct(snake(e["key"]).alias("key"), e["value"].alias("value")))
    keys = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(first)


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    """A scalar as squeezed text; null if nothing is left, and for lists and objects."""
    scalar = F.when(~F.coalesce(F.startswith(_kind(v), F.lit("ARRAY")) | F.startswith(_kind(v), F.lit("OBJECT")), F.lit(False)), F.try_variant_get(v, "$", "string"))
    return F.nullif(X.squeezed(scalar), F.lit(""))


def _texts(v: Column) -> Column:
    """The texts of a list, of an object's values, or of a string cut at commas, semicolons and line ends; each once."""
    parts = F.coalesce(_list(v), F.map_values(F.try_variant_get(v, "$", "map<string, variant>")))
    told = F.coalesce(F.transform(parts, _text_of), F.transform(F.split(F.try_variant_get(v, "$", "string"), r"[,;\n]+"), lambda s: F.nullif(X.squeezed(s), F.lit(""))))
    return F.array_distinct(F.array_compact(told))


def _text_of(v: Column) -> Column:
    return _text(v)


def component_rows(payloads: DataFrame) -> DataFrame:
    """``(id, place, v)`` of ``(id, v)``: all elements of the payloads' lists of components.

    Each step is a column of its own, so that a map that many aliases look into is made once.
    """
    known = F.size(F.array_intersect(F.map_keys("root"), F.array(*map(F.lit, (*ROOT_KEYS, *COMPONENT_LISTS))))) > 0
    inside = F.coalesce(*[F.when(F.startswith(_kind(F.try_element_at("root", F.lit(w))), F.lit("OBJECT")), F.try_element_at("root", F.lit(w))) for w in WRAPPERS])
    rows = payloads.select("id", _map(F.col("v")).alias("root"))
    rows = rows.select("id", "root", F.when(~known, inside).alias("inside"))
    rows = rows.select("id", F.when(F.col("inside").isNull(), F.col("root")).otherwise(_map(F.col("inside"))).alias("body"))
    # one row for each alias that the payload has, in the table's order
    lists = F.array_compact(F.array(*[F.when(F.map_contains_key("body", a), F.struct(F.lit(k).alias("alias"), F.try_element_at("body", F.lit(a)).alias("list"))) for k, a in enumerate(COMPONENT_LISTS)]))
    rows = rows.select("id", F.explode(lists).alias("x")).select("id", "x.alias", "x.list")
    rows = rows.select("id", "alias", "list", _list(F.col("list")).alias("own"), _map(F.col("list")).alias("inner"))
    nested = F.coalesce("own", *[_list(F.try_element_at("inner", F.lit(w))) for w in INNER_LISTS])
    single = F.when(F.exists(F.array(*[F.map_contains_key("inner", a) for a in FIELDS["component_name"]]), lambda x: x), F.array("list"))
    rows = rows.select("id", "alias", F.posexplode(F.coalesce(nested, single)).alias("nth", "v"))
    return rows.select("id", F.struct("alias", "nth").alias("place"), "v")


def components(payloads: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, position, component_name, role_description, boundary_type, external_flag, technology_stack, interfaces, merged, coerced, dropped)``.

    ``merged``: how many components became this one; ``coerced``: values of another type than the
    field's; ``dropped``: fields that none of the aliases names.
    """
    rows = payloads.select(F.col(id_col).alias("id"), X.json_object(F.col(text_col)).alias("v")).where("v is not null")
    rows = component_rows(rows)
    rows = rows.select("id", "place", _kind(F.col("v")).alias("kind"), _text(F.col("v")).alias("text"), _map(F.col("v")).alias("fields"))
    is_text = F.startswith(F.col("kind"), F.lit("STRING"))
    rows = rows.where(is_text | F.col("fields").isNotNull())
    # each value's kind and text once, however many aliases are tried
    read = F.transform_values("fields", lambda _, v: F.struct(_kind(v).alias("kind"), _text(v).alias("text"), v.alias("v")))
    rows = rows.select("id", "place", "text", is_text.alias("is_text"), read.alias("fields"))

    def field(name: str, scalar: bool) -> Column:
        """The first value under the field's aliases that has text, or that is there at all."""
        given = F.array(*[F.try_element_at("fields", F.lit(a)) for a in FIELDS[name]])
        return F.get(F.filter(given, lambda x: x["text"].isNotNull() if scalar else x.isNotNull() & (x["kind"] != "VOID")), F.lit(0)).alias(f"raw_{name}")

    rows = rows.select("*", *[field(n, n in ("component_name", "role_description", "boundary_type")) for n in FIELDS])
    raw = {n: F.col(f"raw_{n}") for n in FIELDS}
    flag = F.lower(raw["external_flag"]["text"])
    stack, faces = raw["technology_stack"], raw["interfaces"]
    is_a = lambda x, *kinds: F.coalesce(x["kind"].rlike(f"^(?:{'|'.join(kinds)})"), F.lit(False))
    other = lambda x, kind: (x.isNotNull() & ~is_a(x, kind)).cast("int")
    coerced = other(raw["component_name"], "STRING") + other(raw["role_description"], "STRING") + other(raw["boundary_type"], "STRING")
    coerced = coerced + other(raw["external_flag"], "BOOLEAN") + is_a(stack, "ARRAY", "OBJECT").cast("int") + other(faces, "ARRAY")
    aliases = [a for names in FIELDS.values() for a in names]
    clean = rows.select(
        "id",
        "place",
        F.when(F.col("is_text"), F.col("text")).otherwise(raw["component_name"]["text"]).alias("component_name"),
        raw["role_description"]["text"].alias("role_description"),
        raw["boundary_type"]["text"].alias("boundary_type"),
        F.when(flag.isin(*YES), True).when(flag.isin(*NO), False).alias("external_flag"),
        F.when(is_a(stack, "ARRAY", "OBJECT"), F.nullif(F.array_join(_texts(stack["v"]), ", "), F.lit(""))).otherwise(stack["text"]).alias("technology_stack"),
        F.coalesce(_texts(faces["v"]), F.array().cast("array<string>")).alias("interfaces"),
        coerced.alias("coerced"),
        F.when(F.col("is_text"), 0).otherwise(F.size(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, aliases))))).alias("dropped"),
    )
    clean = clean.withColumn("key", F.regexp_replace(F.lower("component_name"), r"[^\p{L}\p{N}]+", "")).where("key <> ''")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    merged = clean.groupBy("id", "key").agg(
        F.min("place").alias("place"),
        *[first(c) for c in ("component_name", "role_description", "boundary_type", "external_flag", "technology_stack")],
        F.array_sort(F.collect_list(F.struct("place", "interfaces"))).alias("faces"),
        F.count(F.lit(1)).alias("merged"),
        F.sum("coerced").alias("coerced"),
        F.sum("dropped").alias("dropped"),
    )
    at = F.row_number().over(Window.partitionBy("id").orderBy("place")).cast("bigint").alias("position")
    joined = F.array_distinct(F.flatten(F.transform("faces", lambda x: x["interfaces"]))).alias("interfaces")
    return merged.select(F.col("id").alias(id_col), at, "component_name", "role_description", "boundary_type", "external_flag", "technology_stack", joined, "merged", "coerced", "dropped")
