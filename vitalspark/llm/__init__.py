"""Operators of a training-data pipeline (scoring, counting, fingerprints,
decontamination, chat formatting, filters, encoding, near copies, archives).

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries and their SQL.
"""
