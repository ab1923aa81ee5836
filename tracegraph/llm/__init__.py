"""Training-data operators: deduplication, filtering, extraction, mixing.

Nothing outside this folder imports it. Each module is one operator; ``queries``
registers the thin queries that run the operators over the whole given tables.
"""
