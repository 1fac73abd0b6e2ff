"""Operators for large training-text corpora.

Each module holds one operator with a general interface and the thin query
``opN_<name>`` that applies it to the ``documents`` table. Nothing else in the
library imports this subpackage.
"""
