"""Operators for preparing large text corpora for model training.

Each module holds one operator with a general interface; ``queries`` registers
the thin ``opN_*`` queries over the given tables. Nothing else in the package
imports this subpackage.
"""
