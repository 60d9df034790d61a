"""Queries over model payloads: conversations written as JSON of several shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import payloads as P

from .base import query, table


def _payloads(spark, sf):
    """Each turn is a component, in one of five shapes; turns of even number are components, of odd number services."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    w = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit("none"))
    form = F.col("turn") % 5
    shape = (
        F.when(form == 0, F.concat(F.lit('"'), w(0), F.lit('"')))
        .when(form == 1, F.concat(F.lit('{"Name": "'), w(0), F.lit('", "Description": " '), w(1), F.lit("  "), w(2), F.lit('", "isExternal": "yes"}')))
        .when(form == 2, F.concat(F.lit('{"componentCode": '), (F.col("turn") * 7).cast("string"), F.lit(', "role": "'), w(1), F.lit('", "stack": ["'), w(1), F.lit('", "'), w(2), F.lit('", "'), w(1), F.lit('"]}')))
        .when(form == 3, F.concat(F.lit('{"title": "'), w(0), F.lit('", "layer": "tech", "interface": "'), w(1), F.lit("; "), w(2), F.lit(","), w(1), F.lit('", "unknownField": 1}')))
        .otherwise(F.concat(F.lit('{"name": " ", "details": "'), w(1), F.lit('"}')))
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", shape.alias("shape"))
    of = lambda parity: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == parity, F.struct("turn", "shape")))), lambda x: x["shape"]), ", ")
    both = rows.groupBy("conv_id").agg(of(0).alias("a"), of(1).alias("b"))
    body = F.concat(F.lit('{"Components": ['), "a", F.lit('], "services": {"items": ['), "b", F.lit('], "note": 1}, "other": null}'))
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('{"solution": '), body, F.lit("}"))).when(F.col("conv_id") % 3 == 1, body).otherwise(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
    return both.select("conv_id", text.alias("text"))


@query("""WITH w AS (SELECT conv_id, turn, coalesce(ws[1], 'none') AS a, coalesce(ws[2], 'none') AS b, coalesce(ws[3], 'none') AS c FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM conversations)),
r AS (SELECT conv_id, (turn % 2) * 100000 + turn AS place, CASE turn % 5 WHEN 2 THEN CAST(turn * 7 AS VARCHAR) ELSE a END AS name, CASE turn % 5 WHEN 1 THEN b || ' ' || c WHEN 2 THEN b END AS role, CASE WHEN turn % 5 = 3 THEN 'tech' END AS boundary, CASE WHEN turn % 5 = 1 THEN true END AS external,
  CASE WHEN turn % 5 = 2 THEN CASE WHEN b = c THEN b ELSE b || ', ' || c END END AS stack, CASE WHEN turn % 5 = 3 THEN CASE WHEN b = c THEN [b] ELSE [b, c] END ELSE [] END AS faces, [0, 1, 2, 1][1 + turn % 5] AS coerced, CASE WHEN turn % 5 = 3 THEN 1 ELSE 0 END AS dropped FROM w WHERE turn % 5 < 4),
g AS (SELECT conv_id, lower(name) AS key, min(place) AS place, arg_min(name, place) AS component_name, arg_min(role, place) FILTER (role IS NOT NULL) AS role_description, arg_min(boundary, place) FILTER (boundary IS NOT NULL) AS boundary_type, bool_or(external) AS external_flag,
  arg_min(stack, place) FILTER (stack IS NOT NULL) AS technology_stack, flatten(list(faces ORDER BY place)) AS fs, count(*) AS merged, CAST(sum(coerced) AS BIGINT) AS coerced, CAST(sum(dropped) AS BIGINT) AS dropped FROM r GROUP BY conv_id, lower(name))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS position, component_name, role_description, boundary_type, external_flag, technology_stack, list_transform(list_filter(fs, lambda x, i: list_position(fs, x) = i), lambda x: x) AS interfaces, merged, coerced, dropped FROM g""")
def payload_components(spark, sf):
    """Clean components of payloads of every shape, with what was merged, coerced and dropped."""
    return P.components(_payloads(spark, sf), "conv_id")
