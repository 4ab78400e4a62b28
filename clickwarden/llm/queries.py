"""All queries of this subpackage and their SQL."""

from clickwarden.llm import (
    ann, bpe, chat, collocations, exact_dedup, hard_negatives, license_scan, line_dedup, ngram_join, packing, quality,
    toxicity, warc,
)

_MODULES = [quality, ngram_join, line_dedup, ann, license_scan, bpe, exact_dedup, packing, toxicity, chat, collocations,
            hard_negatives, warc]
QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
