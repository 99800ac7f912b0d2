"""Continuous forms: files of centroids as they arrive, and event-time counts."""
