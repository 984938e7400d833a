"""Training-data operators: search, media, dedup, tokenisation, scans, packing, quality.

Nothing else in the library imports this subpackage; ``queries.py`` holds its
registered queries and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
