"""Operators of a training-data pipeline: scoring, filters, joins, encoding, archives.

Each module holds one operator with its own general interface; ``registry`` holds the
thin ``opN_<name>`` queries over the driver's tables and, where SQL can express them,
their DuckDB SQL.  Nothing else in the library imports this package.
"""
