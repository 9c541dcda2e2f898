"""Corpus operators for training data: joins of near copies, scoring, token output, extraction and packing."""
