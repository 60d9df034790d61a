"""Typed facts, endpoints, terms, rules and page filters on small texts, and against plain versions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import extraction as E
from tessera.operators import pagefilter as PF

CATALOGUE = {
    "risk": (("risk", "data loss"), ("vulnerab",)),
    "constraint": (("limited to",), ()),
    "rule": (("must", "shall"), ()),
    "integration": (("kafka", "rest api"), ()),
    "technology": (("postgres",), ()),
    "architecture": (("bounded context",), ()),
}


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **values):
        kinds = ", ".join(f"{k} string" for k in values)
        return spark.createDataFrame([tuple(values.values())], kinds or "x int").select(column.alias("v")).first()["v"]

    return value


@pytest.mark.parametrize(
    ("text", "category", "want"),
    [
        ("The service MUST log; it shall not. Must!", "rule", ["must", "shall"]),
        ("mustard is no rule, nor a_must", "rule", []),
        ("A vulnerability and vulnerabilities: risk of data  loss", "risk", ["vulnerability", "vulnerabilities", "risk", "data loss"]),
        ("asterisk", "risk", []),
        (None, "risk", []),
    ],
)
def test_markers(one, text, category, want):
    assert one(E.markers(F.col("t"), CATALOGUE, category), t=text) == want


def test_typed_items(spark):
    text = "The gateway must send events over Kafka to Billing Service.\nEach bounded context owns its data, a principle of ours.\nNothing of interest is said in this one."
    rows = E.typed_items(spark.createDataFrame([(1, text, True), (2, text, False), (3, None, True), (4, "", False)], "doc_id int, text string, n boolean"), CATALOGUE, F.col("n")).collect()
    got = {(r.doc_id, r.position, r.item_type, r.confidence) for r in rows if r.item_type != "entity_relation"}
    assert got == {
        (1, 0, "normative_rule", 0.9), (1, 0, "integration_requirement", 0.8), (1, 1, "architectural_principle", 0.78),
        (2, 0, "mandatory_requirement", 0.82), (2, 0, "integration_requirement", 0.8), (2, 1, "architectural_principle", 0.78),
    }
    assert {r.title for r in rows if r.item_type == "entity_relation" and r.position == 0} == {"The gateway must send events over Kafka -> Billing Service."}


def test_sentences_with_markers_come_first(spark):
    text = "\n".join([f"Plain sentence number {k} of this text." for k in range(10)] + ["The system must be up at all times.", "the system MUST be up at all times."])
    rows = E.with_sentences(spark.createDataFrame([(text,), (None,)], "text string"), F.col("text"), CATALOGUE, limit=4).collect()
    assert rows[0].sentences == ["The system must be up at all times.", *(f"Plain sentence number {k} of this text." for k in range(3))] and rows[1].sentences == []


def test_items_once(spark):
    items = spark.createDataFrame([(1, 0, "risk", "A b", "c", 0.7), (1, 1, "risk", "a B", "C", 0.7), (1, 2, "term", "A b", "c", 0.7)], "doc_id int, position int, item_type string, title string, content string, confidence double")
    assert {(r.item_type, r.title) for r in E.distinct_items(items).collect()} == {("risk", "A b"), ("term", "A b")} and E.distinct_items(items.where("false")).count() == 0


def test_endpoints_and_terms(one):
    assert [tuple(x) for x in one(E.endpoints(F.col("t")), t="GET /a/b and POST  /c. TARGET /d; put /e")] == [("GET", "/a/b"), ("POST", "/c.")]
    got = one(E.terms(F.col("t")), t="Knowledge base: a set of versioned documents\nshort: x\nlower case: no term at all here\nLatency is the time to answer")
    assert [x.term for x in got] == ["Knowledge base", "Latency"]
    assert one(E.endpoints(F.col("t")), t=None) == [] and one(E.terms(F.col("t")), t=None) == []


def test_entities_by_force(spark, sf):
    pattern = re.compile(r"\b([A-ZА-Я][A-Za-zА-Яа-я0-9\-]{2,}(?:\s+[A-ZА-Я][A-Za-zА-Яа-я0-9\-]{2,}){0,3})\b")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.substring("text", 1, 20).alias("title"))
    got = {r.doc_id: r.e for r in docs.select("doc_id", E.entities(F.col("title"), F.col("text")).alias("e")).collect()}
    for r in docs.collect():
        names = {r.title.strip(" ")} if len(r.title) > 3 else set()
        names |= {m.strip() for m in pattern.findall(r.text or "")}
        # a hyphen at the end of a word is no letter: leave such texts to the pattern itself
        if "-" not in r.text:
            assert got[r.doc_id] == sorted(names, key=lambda s: s.encode())[:6], r.doc_id


def test_rules(spark):
    text = "Services must log.\n\nIntro\n- The API shall not expose keys\n- services MUST log!\n1. Queues should be durable\n\nNo modal here"
    rows = E.normative_rules(spark.createDataFrame([(1234567, text), (2, None)], "doc_id int, text string"), ("must", "shall", "should"), ("not ",)).collect()
    assert {(r.code, r.category, r.severity, r.negated) for r in rows} == {("COMP-234567-001", "component", "major", False), ("API-234567-001", "api", "critical", True), ("INTE-234567-001", "integration", "minor", False)}


def test_start_offsets(one):
    text = "aa bb\naa bb\ncc"
    chunks = F.array(F.lit("aa bb"), F.lit("aa bb"), F.lit("zz"), F.lit("cc"), F.lit(""))
    assert one(E.start_offsets(F.col("t"), chunks), t=text) == [0, 6, None, 12, None]


def test_importance(spark):
    df = spark.createDataFrame([("The API must answer. GET /v1/items returns the list of items.", "Kafka"), ("", None)], "text string, title string")
    rows = E.with_sentences(df, F.col("text"), CATALOGUE, 12)
    got = [r.v for r in rows.select(E.importance(F.col("sentences"), F.col("text"), F.col("title"), F.lit("Section 4"), F.lit(5), F.lit(20), CATALOGUE).alias("v")).collect()]
    assert got[0] == pytest.approx(4.0 + 3.0 + 1.5 + 61 / 1200 + 0.2) and got[1] == pytest.approx(0.2)


def test_page_filter(spark):
    contents = "Table of contents\n" + "\n".join(f"Chapter {k} ..... {k}" for k in range(8))
    legal = "Legal disclaimer. Provided as is, without warranty."
    texts = [None, " \n", "12 34", "The same page", "the SAME  page 7", contents, legal, "All rights reserved. Evaluation copy. Not for redistribution.", "A page about the system and its warranty, legal disclaimer included: the system keeps the data of the system."]
    rows = PF.classified(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), ("without warranty", "as is"), ("system", "data"))
    got = {r.doc_id: r.reason for r in rows.collect()}
    assert [got[k] for k in range(len(texts))] == ["empty_page", "empty_page", "low_information_page", None, "duplicate_page", "table_of_contents", "legal_disclaimer", "legal_disclaimer", None]
    assert PF.classified(spark.createDataFrame([], "doc_id int, text string"), ("a",), ("b",)).count() == 0


def test_sentences_of_bullets_and_long_ones(one):
    from tessera.functions import text as X

    text = "- First bullet of the list here.\r\n  • second point is here • third point is also here;  fourth one follows here -\nshort.\n\n" + "x" * 1500
    assert one(X.sentences(F.col("t")), t=text) == ["First bullet of the list here.", "second point is here", "third point is also here;", "fourth one follows here", "x" * 1399 + "…"]


def test_marker_tree_equals_the_longest_marker_at_each_place(one):
    import random

    r = random.Random(12)
    word = lambda n: "".join(r.choice("ab-. ") for _ in range(n)).strip()
    for _ in range(12):
        whole, opened = [word(r.randint(1, 5)) for _ in range(4)], [word(r.randint(1, 3)) for _ in range(2)]
        text, found, at = " ".join(word(12).split()), [], 0
        is_word = lambda c: c.isalnum() or c == "_"
        while at < len(text):
            best = ""
            for m in {m for m in (*whole, *opened) if m}:
                end = at + len(m)
                if not text.startswith(m, at) or at and is_word(text[at - 1]):
                    continue
                if m in opened:
                    while end < len(text) and (is_word(text[end]) or text[end] == "-"):
                        end += 1
                elif end < len(text) and is_word(text[end]):
                    continue
                best = max(best, (m, text[at:end]), key=lambda x: len(x[0])) if best else (m, text[at:end])
            if best:
                found.append(best[1])
            at += len(best[1]) if best else 1
        assert one(E.markers(F.col("t"), {"c": (whole, opened)}, "c"), t=text) == list(dict.fromkeys(found)), (whole, opened, text)


def test_relations_are_sought_near_connectors_only(spark):
    """The first relation is the one of the whole pattern, and a far connector doesn't hide it."""
    rng = random.Random(5)
    words = ["Order service", "to", "TO", "->", "→", "—", "tomorrow", "auto", "a" * 90, "x1", "😀", "To", "é", ".", "  ", "\t", "data store", "-", "(", "b-c/d"]
    said = [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    said += ["", "to", "a to b", "aa to bb", "( to b) Alpha Beta to Gamma Delta", "x" * 79 + " -> yy", "x" * 200 + " -> yy", "x" * 80 + "   " + " -> yy"]
    rows = spark.createDataFrame([(s,) for s in said], "s string")
    got = rows.select("s", E.has_relation(F.col("s")).alias("some"), F.regexp_extract(E._near_connector(F.col("s")), E.RELATION, 0).alias("got"), F.regexp_extract("s", E.RELATION, 0).alias("want")).collect()
    assert all(r.got == r.want and r.some == (r.want != "") for r in got) and 100 < sum(r.some for r in got) < len(said)


def test_sentences_are_made_once(spark):
    """No filter before the explode repeats the expression of all sentences."""
    docs = spark.createDataFrame([(1, "Alpha service must not fail. Alpha sends to Beta store."), (2, ""), (3, None)], "doc_id int, text string")
    items = E.typed_items(docs, {"rule": (("must",), ())}, F.lit(False))
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert sum("transform(" in line for line in plan.splitlines()) == 1 and "Filter" in plan
    assert {(r.doc_id, r.item_type) for r in items.collect()} == {(1, "mandatory_requirement"), (1, "entity_relation")}


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """``documents`` of whose texts the last sentences tell, of more sentences with markers than eighty, and with a sentence that tells at its end."""
    plain = [f"Plain sentence number {k} says nothing." for k in range(700)]
    texts = ["\n".join([*plain, "It is licensed by idiot number one.", "Alpha service sends to Beta store."]), "\n".join(["The box must stay shut, always."] * 90), "word " * 400 + "and trash at last -> Gamma store.", "", None]
    folder = tmp_path_factory.mktemp("long")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def _equals_its_sql(spark, folder, name):
    import duckdb
    from oracle import compare

    from tessera.plans import facts
    from tessera.plans.base import SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = getattr(facts, name)(spark, folder)
    assert compare(con, df, SQL[name]) > 0
    return df.collect()


def test_memory_holds_the_whole_text(spark, long_texts):
    rows = _equals_its_sql(spark, long_texts, "document_memory")
    got = {(r.doc_id, r.ordinal): (r.item_type, r.content) for r in rows}
    assert got[0, 2] == ("risk", "It is licensed by idiot number one.") and got[0, 3] == ("entity_relation", "Alpha service sends to Beta store.")
    assert sum(i == 1 for i, _ in got) == 91 and ("risk", "word " * 400 + "and trash at last -> Gamma store.") in got.values()


def test_counters_count_the_whole_text(spark, long_texts):
    got = {r.item_type: (r["items"], r.documents) for r in _equals_its_sql(spark, long_texts, "item_counters")}
    assert got == {"mandatory_requirement": (2, 2), "risk": (2, 2), "entity_relation": (2, 2)}


def test_facts_of_the_whole_text(spark, long_texts):
    rows = _equals_its_sql(spark, long_texts, "typed_facts")
    got = {(r.doc_id, r.position, r.item_type) for r in rows}
    want = {(0, 700, "mandatory_requirement"), (0, 700, "risk"), (0, 701, "entity_relation"), (2, 0, "risk"), (2, 0, "entity_relation")}
    assert got == want | {(1, k, "mandatory_requirement") for k in range(90)} and len(rows) == len(got)
