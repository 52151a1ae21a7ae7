"""Operators for preparing language-model training text.

Each module holds one operator with a general interface; :mod:`kindred.llm.queries` binds them to the
driver's tables. Nothing outside this package imports it.
"""
