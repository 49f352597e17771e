"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, html_main, langid, lexical, near_vectors, ngram_join, periodic, pii, quality, secret_scan, source_mix, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": lambda s, d: secret_scan.digest(table(s, d, "documents")),
        "op2_source_mix": lambda s, d: source_mix.digest(table(s, d, "documents")),
        "op3_bpe": lambda s, d: bpe.digest(table(s, d, "documents")),
        "op4_quality": lambda s, d: quality.digest(table(s, d, "documents"), table(s, d, "labels")),
        "op5_html_main": lambda s, d: html_main.digest(table(s, d, "pages")),
        "op6_langid": lambda s, d: langid.digest(table(s, d, "documents")),
        "op7_ann": lambda s, d: ann.digest(table(s, d, "embeddings")),
        "op8_near_vectors": lambda s, d: near_vectors.digest(table(s, d, "embeddings")),
        "op9_ngram_join": lambda s, d: ngram_join.classes(table(s, d, "documents")),
        "op10_pii": lambda s, d: pii.digest(table(s, d, "documents")),
        "op11_lexical": lambda s, d: lexical.digest(table(s, d, "documents"), table(s, d, "benchmark")),
        "op12_url_filter": lambda s, d: url_filter.digest(table(s, d, "pages")),
        "op13_periodic": lambda s, d: periodic.digest(table(s, d, "documents")),
    }
