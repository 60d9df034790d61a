"""Queries about technology policies. Each line of ``documents`` becomes a line of a policy, each line of ``conversations`` one of a solution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import techpolicy as P

from .base import query, table

_NAMES = ("Ubuntu", "Debian", "CentOS", "RHEL", "Red Hat Enterprise Linux", "Oracle Linux", "Rocky  Linux", "AlmaLinux", "Windows Server", "PostgreSQL", "Java")
_VERSIONS = ("8", "9.4", "10", "11.2.1", "12", "2012", "2016 R2", "20.04 LTS", "22.04", "7")


def _pick(values, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (1 + key % len(values)).cast("int"))


def _product(k: Column) -> Column:
    return F.concat(_pick(_NAMES, k), F.lit(" "), _pick(_VERSIONS, F.floor(k / 3)))


def _texts(spark, sf, name, key, line):
    """A text for each key of the table, of what ``line`` makes of the text's lines."""
    rows = table(spark, sf, name).select(F.col(key).alias("id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    k = F.char_length("line") + 7 * F.col("n")
    # a conversation has several turns: lines are put in order of themselves
    made = rows.select("id", F.col("n"), line(k).alias("x")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("xs"))
    return made.select("id", F.array_join(F.transform("xs", lambda x: x["x"]), "\n").alias("text"))


def _policies(spark, sf):
    first = F.get(F.split("line", " "), F.lit(0))

    def line(k):
        version = _pick(_VERSIONS, F.floor(k / 5))
        return (
            F.when(k % 6 == 0, F.concat(first, F.lit(" "), _product(k), F.lit(" Запрещено")))
            .when(k % 6 == 1, F.concat(_pick(_NAMES, k), F.lit(" all versions below "), version, F.lit(" are forbidden;"), first))
            .when(k % 6 == 2, F.concat(_product(k), F.lit(" — Разрешено")))
            .when(k % 6 == 3, F.concat(_product(k), F.lit("\r\nниже "), version, F.lit(" не рекомендуется")))
            .when(k % 6 == 4, F.concat(F.lit("must not use "), first, F.lit(" | "), _product(k), F.lit(" v.")))
            .otherwise(F.col("line"))
        )

    return _texts(spark, sf, "documents", "doc_id", line).withColumnRenamed("id", "policy")


def _solutions(spark, sf):
    return _texts(spark, sf, "conversations", "conv_id", lambda k: F.when(k % 2 == 0, F.concat("line", F.lit(", "), _product(k + 5))).otherwise(F.col("line"))).withColumnRenamed("id", "solution")


def _sql_pick(values, key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + ({key}) % {len(values)}]"


def _sql_product(k: str) -> str:
    return f"{_sql_pick(_NAMES, k)} || ' ' || {_sql_pick(_VERSIONS, f'({k}) // 3')}"


def _sql_plain(x: str) -> str:
    x = f"regexp_replace(translate(lower({x}), 'ё—–|', 'е   '), '[^a-zа-я0-9.+#]+', ' ', 'g')"
    for _ in range(4):  # a dot between others takes several passes without looking around
        x = rf"regexp_replace({x}, '(^|[^0-9])\.($|[^0-9])', '\1 \2', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _sql_any(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


_KEY = r"(list_transform(regexp_extract_all({0}, '(\d+)', 1), lambda d: CAST(d AS INT))[1:4] || [0, 0, 0, 0])[1:4]"
_PATTERNS = "(VALUES " + ", ".join(rf"({i}, '{p}', '\b(?:{n})\s+(?:{v})\b', '\b(?:{n})\b')" for i, (p, (n, v)) in enumerate(P.PRODUCTS.items())) + ") AS pat(i, product, versioned, named)"
_STOP = ", ".join(f"'{w}'" for w in P.STOPWORDS)
_SQL = rf"""
pl AS (SELECT doc_id AS policy, n, CASE k % 6 WHEN 0 THEN string_split(line, ' ')[1] || ' ' || {_sql_product("k")} || ' Запрещено' WHEN 1 THEN {_sql_pick(_NAMES, "k")} || ' all versions below ' || {_sql_pick(_VERSIONS, "k // 5")} || ' are forbidden;' || string_split(line, ' ')[1]
  WHEN 2 THEN {_sql_product("k")} || ' — Разрешено' WHEN 3 THEN {_sql_product("k")} || chr(13) || chr(10) || 'ниже ' || {_sql_pick(_VERSIONS, "k // 5")} || ' не рекомендуется' WHEN 4 THEN 'must not use ' || string_split(line, ' ')[1] || ' | ' || {_sql_product("k")} || ' v.' ELSE line END AS x
  FROM (SELECT doc_id, n, line, length(line) + 7 * n AS k FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents))),
pt AS (SELECT policy, string_agg(x, chr(10) ORDER BY n) AS text FROM pl GROUP BY policy),
ps AS (SELECT policy, row_number() OVER (PARTITION BY policy ORDER BY o) AS o, line FROM (SELECT policy, unnest(range(len(regexp_split_to_array(text, '[\n\r;]+')))) AS o, unnest(regexp_split_to_array(text, '[\n\r;]+')) AS line FROM pt) WHERE trim(line) <> ''),
pn AS (SELECT *, {_sql_plain("line")} AS p, replace(lower(line), 'ё', 'е') AS low FROM ps),
pm AS (SELECT *, {_sql_any("low", P.FORBIDDING)} AS forbids, {_sql_any("low", P.ALLOWING)} AS allows, coalesce(lag(p) OVER (PARTITION BY policy ORDER BY o), '') AS earlier FROM pn),
own AS (SELECT policy, o, unnest(regexp_extract_all(p, versioned)) AS phrase FROM pm, {_PATTERNS} WHERE forbids),
prev AS (SELECT policy, o, unnest(regexp_extract_all(earlier, versioned)) AS phrase FROM pm, {_PATTERNS} WHERE forbids AND (policy, o) NOT IN (SELECT policy, o FROM own)),
cutat AS (SELECT policy, line, list_min(list_filter(list_transform([{", ".join(f"'{m}'" for m in P.FORBIDDING)}], lambda m: instr(low, m)), lambda x: x > 0)) AS at_ FROM pm WHERE forbids),
sides AS (SELECT policy, list_filter(string_split({_sql_plain("substr(line, 1, at_ - 1)")}, ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))[-6:] AS ws FROM cutat UNION ALL SELECT policy, list_filter(string_split({_sql_plain("substr(line, at_)")}, ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))[1:6] FROM cutat),
told AS (SELECT policy, phrase FROM own UNION SELECT policy, phrase FROM prev UNION SELECT policy, array_to_string(ws, ' ') FROM sides WHERE len(ws) >= 2 OR len(list_filter(ws, lambda w: regexp_matches(w, '\d'))) > 0),
named AS (SELECT policy, o, p, product FROM pm, {_PATTERNS} WHERE forbids AND regexp_matches(p, named)),
prods AS (SELECT * FROM named UNION ALL SELECT policy, o, p, product FROM pm, {_PATTERNS} WHERE forbids AND regexp_matches(earlier, named) AND (policy, o) NOT IN (SELECT policy, o FROM named)),
below AS (SELECT DISTINCT policy, product, v, {_KEY.format("v")} AS key FROM (SELECT policy, product, unnest(regexp_extract_all(p, '{P.BELOW}', 1)) AS v FROM prods)),
allowed AS (SELECT policy, product, v, {_KEY.format("v")} AS key FROM (SELECT policy, product, unnest(regexp_extract_all(p, versioned, 1)) AS v FROM pm, {_PATTERNS} WHERE allows AND NOT forbids)),
ment AS (SELECT policy, phrase, i, product, nth, {_KEY.format("v")} AS key FROM (SELECT policy, phrase, i, product, unnest(range(len(regexp_extract_all(phrase, versioned, 1)))) AS nth, unnest(regexp_extract_all(phrase, versioned, 1)) AS v FROM told, {_PATTERNS})),
floors AS (SELECT m.policy, m.phrase, m.i, m.nth, min(struct_pack(k := a.key, v := a.v)).v AS v FROM ment m JOIN allowed a ON a.policy = m.policy AND a.product = m.product AND m.key < a.key GROUP BY ALL),
hit AS (SELECT told.policy, told.phrase, told.phrase || coalesce(' < ' || f.v, '') AS hit FROM told LEFT JOIN (SELECT policy, phrase, arg_min(v, i * 1000 + nth) AS v FROM floors GROUP BY policy, phrase) f ON f.policy = told.policy AND f.phrase = told.phrase),
sl AS (SELECT conv_id AS solution, n, CASE WHEN k % 2 = 0 THEN line || ', ' || {_sql_product("k + 5")} ELSE line END AS x FROM (SELECT conv_id, n, line, length(line) + 7 * n AS k FROM (SELECT conv_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM conversations))),
st AS (SELECT solution, string_agg(x, chr(10) ORDER BY n, x COLLATE C) AS text FROM sl GROUP BY solution),
sn AS (SELECT *, {_sql_plain("text")} AS p FROM st),
sm AS (SELECT solution, product, phrase, {_KEY.format("v")} AS key FROM (SELECT solution, product, unnest(regexp_extract_all(p, versioned)) AS phrase, unnest(regexp_extract_all(p, versioned, 1)) AS v FROM sn, {_PATTERNS})),
both_ AS (SELECT solution, policy, sn.p, lower(sn.text) AS low, lower(pt.text) AS standard FROM sn JOIN pt ON pt.policy = sn.solution),
found AS (SELECT b.solution, h.hit FROM both_ b JOIN hit h ON h.policy = b.policy AND contains(' ' || b.p || ' ', ' ' || h.phrase || ' ')
  UNION SELECT b.solution, m.phrase || ' < ' || w.v FROM both_ b JOIN sm m ON m.solution = b.solution JOIN below w ON w.policy = b.policy AND w.product = m.product AND m.key < w.key)"""


@query(f"""WITH {_SQL}
SELECT b.solution, b.policy, coalesce(list_sort((SELECT list(hit) FROM found f WHERE f.solution = b.solution)), []) AS hits,
len(list_filter(regexp_extract_all(low, '[a-z0-9_\\-\\.]{{3,}}'), lambda w: w NOT IN ('and', 'the', 'for', 'with', 'без', 'или') AND contains(standard, w))) > 0 AS aligned,
CASE WHEN (SELECT count(*) FROM found f WHERE f.solution = b.solution) > 0 THEN 'failed' WHEN len(list_filter(regexp_extract_all(low, '[a-z0-9_\\-\\.]{{3,}}'), lambda w: w NOT IN ('and', 'the', 'for', 'with', 'без', 'или') AND contains(standard, w))) > 0 THEN 'passed' ELSE 'warning' END AS status FROM both_ b""")
def technology_conflicts(spark, sf):
    """H46, VR-NRM-03: each conversation, as a solution, against the document of its number, as a policy."""
    solutions, policies = _solutions(spark, sf), _policies(spark, sf)
    pairs = solutions.select("solution", F.col("solution").alias("policy"))
    return P.conflicts(solutions, policies, pairs)
