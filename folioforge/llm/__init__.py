"""Operators that prepare large text corpora for model training.

Each module holds one operator with its general interface; ``queries`` applies them to
the tables of a scale-factor folder. Nothing outside this subpackage imports it.
"""
