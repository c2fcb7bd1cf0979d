"""Operators for training-data pipelines. Nothing else in the library imports this package.

Each module holds one operator with a general interface; ``queries`` binds them to the
driver's tables. Common rules, unless a docstring says otherwise: a null text counts as
empty, a null id is a value like any other and sorts last, columns that an operator does
not name are ignored (so extra or clashing names do no harm), an empty table gives an
empty result, and repeated rows are separate documents.
"""
