"""Engagement analytics on Spark DataFrames: scores, baselines, ranks, graphs and review samples."""
