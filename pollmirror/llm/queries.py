"""Registered queries of the corpus operators, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .bpe import bpe_digests
from .common import load
from .exact_dedup import EXACT_SQL, exact_dedup
from .language_id import identify_languages
from .licenses import scan_licenses
from .mixing import mix_report, mix_sql
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import packing_digests
from .ppm import score_texts
from .quality import classify_quality
from .search import SEARCH_SQL, rank_documents
from .secrets import scan_secrets
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": lambda s, d: identify_languages(load(s, d, "documents")),
    "op2_mix_sources": lambda s, d: mix_report(load(s, d, "documents")),
    "op3_nearest_neighbours": lambda s, d: nearest(load(s, d, "embeddings")),
    "op4_quality": lambda s, d: classify_quality(load(s, d, "documents"), load(s, d, "labels")),
    "op5_near_dedup": lambda s, d: near_duplicates(load(s, d, "documents")),
    "op6_exact_dedup": lambda s, d: exact_dedup(load(s, d, "documents")),
    "op7_license_scan": lambda s, d: scan_licenses(load(s, d, "documents")),
    "op8_ppm_score": lambda s, d: score_texts(load(s, d, "documents")),
    "op9_secret_scan": lambda s, d: scan_secrets(load(s, d, "documents")),
    "op10_bpe": lambda s, d: bpe_digests(load(s, d, "documents")),
    "op11_ranked_search": lambda s, d: rank_documents(load(s, d, "documents"), load(s, d, "benchmark")),
    "op12_whitening": lambda s, d: whiten(load(s, d, "embeddings")),
    "op13_packing": lambda s, d: packing_digests(load(s, d, "documents")),
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_mix_sources": f"SELECT doc_id, size, source_size, target, taken, copies FROM ({mix_sql()})",
    "op6_exact_dedup": EXACT_SQL,
    "op11_ranked_search": SEARCH_SQL,
}
