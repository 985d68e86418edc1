"""Scans and sinks."""

from riskloom.sources.readers import by_file_name, coded_csv, embedded_json, empty_like, harmonised, json_documents, non_empty, optional, resolved, windowed
from riskloom.sources.writers import append_run, gathered, overwrite, replace_partitions, text_metrics

__all__ = ["append_run", "by_file_name", "coded_csv", "embedded_json", "empty_like", "gathered", "harmonised", "json_documents", "non_empty", "optional", "overwrite", "replace_partitions", "resolved", "text_metrics", "windowed"]
