"""Operators of a training-data pipeline; nothing else in the library imports them."""

from riskloom.llm import chat, decontaminate, language_id, mixing, pii, quality_classifier, quality_rules, ranked_search, secret_scan, simhash, suffix_dedup, token_alignment, url_filters

_ALL = (quality_rules, url_filters, language_id, simhash, mixing, decontaminate, secret_scan, pii, chat, suffix_dedup, ranked_search, quality_classifier, token_alignment)
QUERIES = {name: query for module in _ALL for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _ALL for name, sql in module.ORACLE_SQL.items()}
