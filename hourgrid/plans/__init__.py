"""Composed pipelines, the query catalog and the matching oracle SQL."""
