"""What the answers about a task tell, and whether the task is ready.

Six questions have aspects; an answer has an aspect if it holds a phrase of one of its groups,
or a sign such as a digit. One automaton finds the groups of all questions in one pass
over a text, so a task's text is read once for six questions. What makes an answer
``ready`` or ``partial`` is a table of conditions, each "at least so many of these facts".

Defined results: a null or blank text has no normalised answer and lacks every aspect; an
answer that is one of the low-signal words lacks every aspect too; an explicit "there are none"
has all aspects; of several answers to one question of a task the best status counts; tasks
without answers are judged by their text; extra columns stay, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.automaton import Automaton

CODES = ("goal", "context", "constraints", "integrations", "expected_output", "nfr")
#: Answers that say nothing: fixed values.
LOW_SIGNAL = ("n/a", "na", "нет", "не знаю", "unknown", "none", "-", "?", "todo", "tbd", "пока не знаю", "непонятно", "без деталей", "что-нибудь", "как-нибудь", "потом уточню")
#: Phrases of each question's groups: fixed values.
GOAL = {
    "objective": ("цель", "целевой", "сниз", "уменьш", "ускор", "автомат", "повыс", "сократ", "оптимиз", "обеспеч", "мигр", "внедр", "улучш"),
    "subject": ("процесс", "заяв", "заказ", "клиент", "отчет", "сервис", "систем", "данн", "интеграц", "канал", "поток", "документ"),
    "business_effect": ("результат", "чтобы", "для того", "в результате", "эффект", "outcome", "business outcome", "эконом", "sla", "доступност", "качеств", "точност", "срок", "время", "стоим", "метрик", "kpi"),
}
CONTEXT = {
    "current_state": ("сейчас", "текущ", "as is", "существующ", "сегодня", "имеется", "используется", "контекст"),
    "scope_entity": ("систем", "процесс", "контур", "модул", "приложен", "команд", "пользоват", "канал", "crm", "erp", "sap", "1с", "kafka", "шина"),
    "pain_point": ("проблем", "ручн", "ошиб", "долго", "узк", "не хватает", "разрознен", "задерж", "неудоб", "дублир", "потер"),
}
CONSTRAINTS = {
    "none": ("ограничений нет", "жестких ограничений нет", "без ограничений", "нет специальных ограничений"),
    "generic": ("огранич",),
    "time": ("срок", "дедлайн", "недел", "месяц", "квартал"),
    "security": ("безопас", "шифр", "доступ", "персональн", "auth", "sso"),
    "performance": ("sla", "latency", "нагруз", "производ", "доступност", "rps"),
    "budget": ("бюдж", "стоим", "затрат", "финанс"),
    "compliance": ("регламент", "норматив", "152-фз", "audit", "соответств"),
    "detail": ("не более", "не меньше", "только", "запрещ", "обязательно", "должен", "нельзя", "допускается"),
}
INTEGRATIONS = {
    "none": ("интеграций нет", "без интеграций", "внешних систем нет", "автономно", "изолированно"),
    "counterparty": ("sap", "1с", "crm", "erp", "dwh", "kafka", "postgres", "oracle", "email", "ldap", "ad", "billing", "api gateway", "service bus", "очеред", "интегр", "внешн", "смежн", "систем"),
    "exchange_mode": ("api", "rest", "soap", "webhook", "файл", "обмен", "событ", "очеред", "mq", "данн", "статус", "запрос", "синхрон", "асинхрон"),
}
EXPECTED_OUTPUT = {
    "marker": ("ожидаемый результат", "результат на выходе", "на выходе", "формат результата", "итоговый артефакт", "нужен артефакт", "deliverable", "output"),
    "artifact_type": ("hld", "high-level", "концепт", "концепция", "архитектурн", "решени", "дизайн", "компонентн", "интеграцион", "диаграм", "схем", "модель", "документ", "артефакт", "рекомендац"),
    "detail_level": ("верхнеуров", "high-level", "hld", "деталь", "на уровне", "для согласования", "чернов", "подроб", "только концепт", "без детализации", "фокус", "вариант"),
}
NFR = {
    "none": (
        "nfr нет", "нфт нет", "нфр нет", "нет nfr", "нет нфт", "нет нфр", "нет специальных nfr", "нет специальных нфт", "нет специальных нфр", "нет специальных нефункциональных", "нефункциональных требований нет",
        "особых нефункциональных требований нет", "без специальных нефункциональных", "nfr не важны", "нфт не важны", "нфр не важны",
    ),
    "security": ("безопас", "доступ", "аутенти", "авториз", "шифр", "tls", "sso", "mfa", "rbac", "персональн", "security", "authentication", "authorization", "encryption"),
    "availability": ("доступност", "отказоуст", "резервирован", "реплика", "кластер", "failover", "availability", "ha", "resilience", "redundancy"),
    "performance": ("производ", "нагруз", "задерж", "масштаб", "sla", "rps", "latency", "throughput", "performance", "scalability"),
    "operations": ("монитор", "лог", "метрик", "трасс", "alert", "backup", "бэкап", "резервн", "восстанов", "rpo", "rto", "observability", "monitoring"),
    "marker": ("nfr", "нфт", "нфр", "нефункциональн", "не функциональн", "non-functional", "quality attribute", "атрибут качеств"),
}
PHRASES = {"goal": GOAL, "context": CONTEXT, "constraints": CONSTRAINTS, "integrations": INTEGRATIONS, "expected_output": EXPECTED_OUTPUT, "nfr": NFR}
#: Questions, and what is asked for each missing aspect: fixed values.
QUESTIONS = {
    "goal": "Основная цель решения и бизнес-результат.",
    "context": "Текущий контекст, окружение или исходная система.",
    "constraints": "Ограничения и обязательные условия.",
    "integrations": "Интеграции с системами, API, сервисами или данными.",
    "expected_output": "Ожидаемый результат и формат архитектурного артефакта.",
    "nfr": "Нефункциональные требования: безопасность, доступность, производительность, мониторинг и резервное копирование.",
}
LABELS = {
    "goal": {"objective": "что именно нужно изменить", "subject": "какой объект или процесс затрагиваем", "business_effect": "какой ожидается бизнес-эффект или метрика результата"},
    "context": {"current_state": "что есть сейчас", "scope_entity": "какая система, процесс или контур рассматривается", "pain_point": "какая проблема или исходная точка наблюдается"},
    "constraints": {"constraint_category": "какие именно ограничения важны", "constraint_detail": "в чём выражается ограничение"},
    "integrations": {"counterparty": "с чем именно нужно интегрироваться", "exchange_mode": "какой обмен или интерфейс ожидается"},
    "expected_output": {"artifact_type": "какой именно артефакт нужен на выходе", "detail_level": "какая нужна глубина или фокус результата"},
    "nfr": {"security": "требования безопасности и доступа", "availability": "доступность или отказоустойчивость", "performance": "производительность, нагрузка или SLA", "operations": "мониторинг, резервное копирование или восстановление"},
}
_CATEGORIES = ("generic", "time", "security", "performance", "budget", "compliance")
#: Facts of which one gives an aspect that isn't a group of its own.
ASPECT_FACTS = {
    ("goal", "subject"): ("subject", "+long words"),
    ("goal", "business_effect"): ("business_effect", "+digit"),
    ("constraints", "constraint_category"): _CATEGORIES,
    ("constraints", "constraint_detail"): ("detail", "+digit"),
}
#: ``(question, status, at least so many, of these)``; aspects and facts count alike, the first that holds decides.
CONDITIONS = (
    ("goal", "ready", 3, ("objective", "subject", "business_effect")),
    ("goal", "partial", 2, ("objective", "subject", "business_effect")),
    ("context", "ready", 2, ("current_state", "scope_entity")),
    ("context", "ready", 2, ("current_state", "pain_point")),
    ("context", "partial", 1, ("current_state", "scope_entity", "pain_point")),
    ("constraints", "ready", 1, ("none",)),
    ("constraints", "ready", 2, ("constraint_category", "constraint_detail")),
    ("constraints", "ready", 2, _CATEGORIES),
    ("constraints", "partial", 1, ("constraint_category", "constraint_detail")),
    ("integrations", "ready", 1, ("none",)),
    ("integrations", "ready", 2, ("counterparty", "exchange_mode")),
    ("integrations", "partial", 1, ("counterparty", "exchange_mode")),
    ("expected_output", "ready", 2, ("artifact_type", "detail_level")),
    ("expected_output", "ready", 2, ("artifact_type", "marker")),
    ("expected_output", "ready", 2, ("artifact_type", "+short")),
    ("expected_output", "partial", 1, ("artifact_type", "detail_level")),
    ("nfr", "ready", 1, ("none",)),
    ("nfr", "ready", 3, ("security", "availability", "performance", "operations")),
    ("nfr", "ready", 2, ("+any", "marker")),
    ("nfr", "ready", 2, ("+any", "+short")),
    ("nfr", "partial", 1, ("security", "availability", "performance", "operations")),
)
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def with_facts(texts: DataFrame, text_col: str = "text", phrases: Mapping[str, Mapping[str, tuple[str, ...]]] = PHRASES) -> DataFrame:
    """``texts`` with ``normalized`` and ``facts``: the groups that it has, as ``question.group``, and signs that begin with ``+``."""
    flat = F.trim(F.regexp_replace(text_col, SPACE, " "))
    frame = texts.withColumn("normalized", F.when(flat != "", flat))
    automaton = Automaton({f"{code}.{group}": found for code, groups in phrases.items() for group, found in groups.items()})

    def facts(text: str | None) -> list[str]:
        if text is None:
            return []
        low = text.lower()
        words = low.split(" ")
        signs = {"+digit": any(map(str.isdigit, low)), "+short": len(words) <= 12, "+long words": sum(len(w) >= 5 for w in words) >= 3}
        return automaton.groups(low) + [k for k, v in signs.items() if v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(map(facts, batch.column("normalized").to_pylist()), pa.list_(pa.string()))
            yield batch.append_column("facts", found)

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("facts", T.ArrayType(T.StringType()))]))


def _of(code: str, facts: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x if x[0] == "+" else f"{code}.{x}") for x in facts])


def _prefixed(code: str, names: Column) -> Column:
    return F.transform(names, lambda a: F.concat(F.lit(f"{code}."), a))


def evaluated(answers: DataFrame) -> DataFrame:
    """Rows with a question ``code`` and the facts of their text, with status, aspects found and missing, and two flags."""
    facts = F.col("facts")
    status, found, missing = (F.lit(None).cast(t) for t in ("string", "array<string>", "array<string>"))
    negative = F.lit(False)
    low = F.coalesce(F.lower("normalized").isin(*LOW_SIGNAL), F.lit(False))
    for code in CODES:
        aspects, here = tuple(LABELS[code]), F.col("code") == code
        none = (F.array_contains(facts, f"{code}.none") & ~low) if "none" in PHRASES[code] else F.lit(False)
        has = F.filter(F.array(*[F.when(F.size(F.array_intersect(facts, _of(code, ASPECT_FACTS.get((code, a), (a,))))) > 0, F.lit(a)) for a in aspects]), lambda a: a.isNotNull())
        has = F.when(low, F.array().cast("array<string>")).when(none, F.array(*map(F.lit, aspects))).otherwise(has)
        # aspects take part in the conditions beside the facts
        known = F.concat(facts, _prefixed(code, has), F.when(F.size(has) > 0, F.array(F.lit("+any"))).otherwise(F.array().cast("array<string>")))
        chosen = F.lit(None).cast("string")
        for _, value, least, of in reversed([c for c in CONDITIONS if c[0] == code]):
            chosen = F.when(F.size(F.array_intersect(known, _of(code, of))) >= least, value).otherwise(chosen)
        status = F.when(here, F.when(low, "insufficient").otherwise(F.coalesce(chosen, F.lit("insufficient")))).otherwise(status)
        found = F.when(here, has).otherwise(found)
        missing = F.when(here, F.array_except(F.array(*map(F.lit, aspects)), has)).otherwise(missing)
        negative = F.when(here, none).otherwise(negative)
    return answers.withColumns({"status": status, "found_aspects": found, "missing_aspects": missing, "low_signal": low, "explicit_negative": negative})


def answer_aspects(answers: DataFrame, text_col: str = "text") -> DataFrame:
    """Each answer ``(..., code, text)`` judged by its question."""
    return evaluated(with_facts(answers, text_col)).drop("facts")


def _question(code: Column, missing: Column) -> Column:
    """The question's text, with what is still to be told."""
    base = F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv])[code]
    labels = F.create_map(*[F.lit(x) for c, ls in LABELS.items() for a, t in ls.items() for x in (f"{c}.{a}", t)])
    details = F.transform(missing, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), F.element_at(labels, F.concat(code, F.lit("."), a)), F.lit(";")))
    return F.when(F.size(missing) == 0, base).otherwise(F.concat(base, F.lit(" Уточните детали: "), F.array_join(details, " ")))


def assess(tasks: DataFrame, task_col: str = "task") -> DataFrame:
    """``(task, ready, missing, questions, substantive, notes)`` of ``(task, text, notes, answers, context, expected_output)``.

    ``notes`` is an array or null, ``answers`` a map from question to answer or null. A question is
    answered if its answer, or text and notes together, or (for two questions) the
    field of its name is ready.
    """
    note = lambda x: F.filter(F.transform(x, lambda n: F.trim(n)), lambda n: n != "")
    notes = note(F.coalesce("notes", F.when(F.col("context").isNotNull(), F.array("context")), F.array().cast("array<string>")))
    known = tasks.select(F.col(task_col).alias("task"), F.coalesce(F.trim("text"), F.lit("")).alias("text"), notes.alias("notes"), "answers", "context", "expected_output")
    parts = [
        F.struct(F.lit("text").alias("kind"), F.array(*map(F.lit, CODES)).alias("codes"), F.concat_ws("\n", "text", "notes").alias("text")),
        *[F.struct(F.lit("field").alias("kind"), F.array(F.lit(c)).alias("codes"), F.col(c).alias("text")) for c in ("context", "expected_output")],
        *[F.struct(F.lit("answer").alias("kind"), F.array(F.lit(c)).alias("codes"), F.element_at("answers", F.lit(c)).alias("text")) for c in CODES],
    ]
    rows = known.select("task", F.size("notes").cast("bigint").alias("notes"), F.explode(F.array(*parts)).alias("x")).select("task", "notes", "x.*").where("kind = 'text' or text is not null")
    judged = evaluated(with_facts(rows).withColumn("code", F.explode("codes")).drop("codes"))
    # what a question asks for is told by its answer if there is one, else by the text
    told = F.struct((F.col("kind") != "answer").alias("later"), "missing_aspects")
    by_code = judged.groupBy("task", "code").agg(
        F.max(F.col("status") == "ready").alias("present"),
        F.min(F.when((F.col("kind") == "text") | (F.col("kind") == "answer") & F.col("normalized").isNotNull(), told)).alias("told"),
        F.max((F.col("kind") == "answer") & F.col("status").isin("ready", "partial")).alias("substantive"),
        F.max("notes").alias("notes"),
    )
    order = F.array_position(F.array(*map(F.lit, CODES)), F.col("code")).alias("at")
    by_code = by_code.select("task", "notes", order, "code", "present", "substantive", _question(F.col("code"), F.col("told.missing_aspects")).alias("question"))
    all_of = by_code.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("at", "code", "present", "substantive", "question"))).alias("xs"), F.max("notes").alias("notes"))
    pick = lambda keep, field: F.transform(F.filter("xs", keep), lambda x: x[field])
    missing = pick(lambda x: ~x["present"], "code")
    return all_of.select(F.col("task").alias(task_col), (F.size(missing) == 0).alias("ready"), missing.alias("missing"), pick(lambda x: ~x["present"], "question").alias("questions"), pick(lambda x: x["substantive"], "code").alias("substantive"), "notes")
