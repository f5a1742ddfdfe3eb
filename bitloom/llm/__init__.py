"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries only when it can be imported.
"""

from bitloom.llm.entries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
