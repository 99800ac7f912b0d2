"""Readers and writers of catalogues, centroids, images and pair indexes."""
