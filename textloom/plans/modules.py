"""Imports every module that registers queries."""

from textloom.plans import corpus_queries, explain_queries, feature_queries, metric_queries, model_queries, store_queries, text_queries, window_queries  # noqa: F401
