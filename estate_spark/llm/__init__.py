"""Operators for training-data corpora: tokens, languages, toxicity, neighbours, archives, copies, URLs, leaks."""
