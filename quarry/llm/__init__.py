"""Operators of a training-data pipeline: chat formatting, sharding, near-duplicates, quality
and secret rules, tokenisation, toxicity, substring removal and benchmark decontamination.

Nothing else in the library imports this subpackage.
"""
