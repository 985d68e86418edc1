"""Continuous ingest, state and aggregates with Structured Streaming."""

from riskloom.streaming.jobs import buckets, daily_totals, drain, feed_panel, insert_events, keyed_state, landed, online_scores, panel_of, upsert_articles, upsert_messages

__all__ = ["buckets", "daily_totals", "drain", "feed_panel", "insert_events", "keyed_state", "landed", "online_scores", "panel_of", "upsert_articles", "upsert_messages"]
