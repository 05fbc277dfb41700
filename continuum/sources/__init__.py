"""Corpus readers, the run catalogue, result tables and the shared work folder."""
