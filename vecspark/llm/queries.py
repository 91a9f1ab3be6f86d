"""The registered queries of the operators, one module each."""

from __future__ import annotations

from vecspark.llm import bpe, fingerprint, hard_negatives, language_id, merkle, mixing, ngram_join, quality, sharding, suffix_dedup, toxicity, url_filter, warc  # noqa: F401
from vecspark.llm.register import ORACLES, QUERIES  # noqa: F401
