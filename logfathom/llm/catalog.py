"""All queries of the subpackage and their SQL."""

from logfathom.llm import (
    byte_pairs,
    chat_examples,
    exact_dedup,
    language,
    merkle,
    mixing,
    near_dedup,
    periodic_runs,
    personal_data,
    pieces,
    quality,
    token_files,
    warc_package,
)

MODULES = (
    warc_package, chat_examples, quality, pieces, token_files, near_dedup, language, personal_data, mixing, exact_dedup,
    merkle, periodic_runs, byte_pairs,
)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
