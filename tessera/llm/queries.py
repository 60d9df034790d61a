"""The numbered operators as queries ``(spark, sf_dir) -> DataFrame``, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import bpe, decontamination, embeddings, exact, html, packing, prefixes, quality, simhash, spellings, substrings, toxicity, urls
from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark, sf_dir):
    return packing.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_quality(spark, sf_dir):
    return quality.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark, sf_dir):
    return simhash.digests(table(spark, sf_dir, "documents"))


def op4_substrings(spark, sf_dir):
    return substrings.digests(table(spark, sf_dir, "documents"))


def op5_exact(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_html(spark, sf_dir):
    return html.digests(table(spark, sf_dir, "pages"))


def op7_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_embeddings(spark, sf_dir):
    return embeddings.digests(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_urls(spark, sf_dir):
    return urls.digests(table(spark, sf_dir, "pages"))


def op11_spellings(spark, sf_dir):
    return spellings.digests(table(spark, sf_dir, "documents"))


def op12_prefixes(spark, sf_dir):
    return prefixes.digests(table(spark, sf_dir, "conversations"))


def op13_decontamination(spark, sf_dir):
    return decontamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    found = (op1_packing, op2_quality, op3_simhash, op4_substrings, op5_exact, op6_html, op7_bpe, op8_embeddings, op9_toxicity, op10_urls, op11_spellings, op12_prefixes, op13_decontamination)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op4_substrings": substrings.ORACLE_SQL, "op5_exact": exact.ORACLE_SQL, "op8_embeddings": embeddings.ORACLE_SQL, "op11_spellings": spellings.ORACLE_SQL, "op12_prefixes": prefixes.ORACLE_SQL, "op13_decontamination": decontamination.ORACLE_SQL}
