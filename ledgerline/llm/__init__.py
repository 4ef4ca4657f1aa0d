"""Training-data operators: search, archives, mixing, extraction, filters, dedup, scoring.

Each module holds one operator with its own interface; ``queries`` has the thin
``opN_<name>`` queries over the given tables and their SQL.
"""
