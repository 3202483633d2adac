"""Operators for preparing language-model training data, as Spark jobs.

Nothing else in the library imports this subpackage.  One module per
operator; ``queries`` holds the registered queries and ``oracle`` their SQL.
"""
