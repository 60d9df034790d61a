"""Queries about answers and tasks. Every line of ``conversations`` is an answer; some of its words become phrases of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import readiness as R

from .base import query, table

_POOL = [p for groups in R.PHRASES.values() for phrases in groups.values() for p in phrases]


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _has(code: str, *groups: str) -> str:
    return f"len(list_filter({_list(p for g in groups for p in R.PHRASES[code][g])}, lambda p: contains(low, p))) > 0"


def _aspects(**named: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in named.items()) + "], lambda x: x IS NOT NULL)"


_DIGIT = r"regexp_matches(low, '\p{Nd}')"
_WORDS = "string_split(low, ' ')"
_CATEGORIES = " + ".join(f"CAST({_has('constraints', g)} AS INT)" for g in ("generic", "time", "security", "performance", "budget", "compliance"))
_LINES = rf"""l AS (SELECT conv_id, turn, n, list_transform(string_split(line, ' '), lambda w, i: CASE WHEN (i * i + 31 * length(w) + ascii(w)) % 11 = 0 THEN {_list(_POOL)}[1 + ((i * i + 31 * length(w) + ascii(w)) // 11) % {len(_POOL)}] ELSE w END) AS ws
  FROM (SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM conversations)),
said AS (SELECT conv_id, turn, n, {_list(R.CODES)}[1 + (turn + n) % 6] AS code, array_to_string(ws, ' ') AS line FROM l)"""


def _judged(given: str) -> str:
    """The rows of ``given``, which have a code and a line, with their aspects and status: rules as they stand in the survey."""
    return rf"""f AS (SELECT *, nullif(trim(regexp_replace(line, '{R.SPACE}', ' ', 'g')), '') AS norm FROM {given}),
low AS (SELECT *, lower(norm) AS low, lower(norm) IN ({", ".join(f"'{x}'" for x in R.LOW_SIGNAL)}) AS weak FROM f),
neg AS (SELECT *, coalesce(NOT weak AND CASE code WHEN 'constraints' THEN {_has("constraints", "none")} WHEN 'integrations' THEN {_has("integrations", "none")} WHEN 'nfr' THEN {_has("nfr", "none")} ELSE false END, false) AS negative FROM low),
asp AS (SELECT *, CASE WHEN norm IS NULL OR weak THEN [] WHEN code = 'goal' THEN {_aspects(objective=_has("goal", "objective"), subject=_has("goal", "subject") + f" OR len(list_filter({_WORDS}, lambda w: length(w) >= 5)) >= 3", business_effect=_has("goal", "business_effect") + " OR " + _DIGIT)}
  WHEN code = 'context' THEN {_aspects(**{g: _has("context", g) for g in ("current_state", "scope_entity", "pain_point")})}
  WHEN negative AND code = 'constraints' THEN ['constraint_category', 'constraint_detail'] WHEN negative AND code = 'integrations' THEN ['counterparty', 'exchange_mode'] WHEN negative THEN ['security', 'availability', 'performance', 'operations']
  WHEN code = 'constraints' THEN {_aspects(constraint_category=f"{_CATEGORIES} > 0", constraint_detail=_has("constraints", "detail") + " OR " + _DIGIT)}
  WHEN code = 'integrations' THEN {_aspects(**{g: _has("integrations", g) for g in ("counterparty", "exchange_mode")})}
  WHEN code = 'expected_output' THEN {_aspects(**{g: _has("expected_output", g) for g in ("artifact_type", "detail_level")})}
  ELSE {_aspects(**{g: _has("nfr", g) for g in ("security", "availability", "performance", "operations")})} END AS found FROM neg),
judged AS (SELECT *, CASE WHEN len(found) = 0 THEN 'insufficient' WHEN negative THEN 'ready'
  WHEN code = 'goal' THEN CASE len(found) WHEN 3 THEN 'ready' WHEN 2 THEN 'partial' ELSE 'insufficient' END
  WHEN code = 'context' THEN CASE WHEN list_contains(found, 'current_state') AND len(found) >= 2 THEN 'ready' ELSE 'partial' END
  WHEN code = 'constraints' THEN CASE WHEN len(found) = 2 OR {_CATEGORIES} >= 2 THEN 'ready' ELSE 'partial' END
  WHEN code = 'integrations' THEN CASE WHEN len(found) = 2 THEN 'ready' ELSE 'partial' END
  WHEN code = 'expected_output' THEN CASE WHEN list_contains(found, 'artifact_type') AND (len(found) = 2 OR {_has("expected_output", "marker")} OR len({_WORDS}) <= 12) THEN 'ready' ELSE 'partial' END
  ELSE CASE WHEN len(found) >= 3 OR {_has("nfr", "marker")} OR len({_WORDS}) <= 12 THEN 'ready' ELSE 'partial' END END AS status,
  list_filter(CASE code {" ".join(f"WHEN '{c}' THEN {_list(ls)}" for c, ls in R.LABELS.items())} END, lambda a: NOT list_contains(found, a)) AS missing FROM asp)"""


def _said(spark, sf):
    pool, n = F.array(*map(F.lit, _POOL)), len(_POOL)

    def word(w, i):
        key = (i + 1) * (i + 1) + 31 * F.char_length(w) + F.ascii(w)
        return F.when(key % 11 == 0, F.element_at(pool, (1 + F.floor(key / 11) % n).cast("int"))).otherwise(w)

    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    code = F.element_at(F.array(*map(F.lit, R.CODES)), (1 + (F.col("turn") + F.col("n")) % 6).cast("int"))
    return lines.select("conv_id", "turn", F.col("n").cast("bigint").alias("n"), code.alias("code"), F.array_join(F.transform(F.split("line", " "), word), " ").alias("line"))


@query(f"WITH {_LINES}, {_judged('said')} SELECT conv_id, turn, n, code, status, norm AS normalized, found AS found_aspects, missing AS missing_aspects, coalesce(weak, false) AS low_signal, negative AS explicit_negative FROM judged")
def answer_aspects(spark, sf):
    """What each line tells as an answer to one of six questions."""
    return R.answer_aspects(_said(spark, sf).withColumnRenamed("line", "text")).drop("text")


@query(rf"""WITH {_LINES},
task AS (SELECT conv_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (turn = 0), '') AS text, max(line) FILTER (turn = 2 AND line <> '') AS context, max(line) FILTER (turn = 3 AND line <> '') AS expected FROM said GROUP BY conv_id),
rows AS (SELECT conv_id, 'text' AS kind, unnest({_list(R.CODES)}) AS code, trim(text) || coalesce(chr(10) || nullif(trim(context), ''), '') AS line FROM task
  UNION ALL SELECT conv_id, 'field', 'context', context FROM task WHERE context IS NOT NULL UNION ALL SELECT conv_id, 'field', 'expected_output', expected FROM task WHERE expected IS NOT NULL
  UNION ALL SELECT conv_id, 'answer', code, max(line) FROM said WHERE turn > 0 AND line <> '' GROUP BY conv_id, code),
{_judged("rows")},
by_code AS (SELECT conv_id, code, bool_or(status = 'ready') AS present, coalesce(max(missing) FILTER (kind = 'answer' AND norm IS NOT NULL), max(missing) FILTER (kind = 'text')) AS missing, bool_or(kind = 'answer' AND status IN ('ready', 'partial')) AS substantive FROM judged GROUP BY conv_id, code),
q AS (SELECT *, list_position({_list(R.CODES)}, code) AS nth, CASE code {" ".join(f"WHEN '{c}' THEN '{t}'" for c, t in R.QUESTIONS.items())} END
  || CASE WHEN len(missing) = 0 THEN '' ELSE ' Уточните детали: ' || array_to_string(list_transform(missing, lambda a, i: i || '. ' || CASE code {" ".join(f"WHEN '{c}' THEN CASE a {' '.join(f'''WHEN '{a}' THEN '{t}' ''' for a, t in ls.items())}END" for c, ls in R.LABELS.items())} END || ';'), ' ') END AS question FROM by_code)
SELECT q.conv_id, bool_and(present) AS ready, coalesce(list(code ORDER BY nth) FILTER (NOT present), []) AS missing, coalesce(list(question ORDER BY nth) FILTER (NOT present), []) AS questions, coalesce(list(code ORDER BY nth) FILTER (substantive), []) AS substantive,
  max(CASE WHEN trim(context) <> '' THEN 1 ELSE 0 END)::BIGINT AS notes FROM q JOIN task USING (conv_id) GROUP BY q.conv_id""")
def task_readiness(spark, sf):
    """Each conversation as a task: its first turn is the text, later lines are answers and fields."""
    said = _said(spark, sf)
    full = F.col("line") != ""
    answers = said.where((F.col("turn") > 0) & full).groupBy("conv_id", "code").agg(F.max("line").alias("line")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "line"))).alias("answers"))
    lines = F.array_sort(F.collect_list(F.when(F.col("turn") == 0, F.struct("n", "line"))))
    at = lambda turn: F.max(F.when((F.col("turn") == turn) & full, F.col("line")))
    tasks = said.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"), at(2).alias("context"), at(3).alias("expected_output"))
    tasks = tasks.join(answers, "conv_id", "left").withColumn("notes", F.lit(None).cast("array<string>"))
    return R.assess(tasks, "conv_id")
