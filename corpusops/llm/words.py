"""Vectorised hashing of words, shared with the core."""

from corpusops.functions.words import WINDOW, mix, multiset_overlap, positions_in_runs, powers, runs, span_hashes, utf8, windows, word_hashes  # noqa: F401
