"""Training-data operators: packing, tokenizers, dedup, search, quality, toxicity, WARC.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and ``ORACLE_SQL`` their SQL counterparts.
"""
