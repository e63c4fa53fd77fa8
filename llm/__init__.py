"""Operators for preparing language-model training data, all on Spark DataFrames.

Nothing outside this folder imports it.  Each operator has a module with a general
interface; ``llm.queries`` holds the thin registered queries.
"""
