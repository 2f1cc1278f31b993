"""Operators for training-data pipelines. `registry` lists their queries and oracle SQL."""
