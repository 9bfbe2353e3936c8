"""Training-data operators: tokens, secrets, mixing, near-duplicates, filters.

Nothing else in the library imports this subpackage. The registered queries
are in ``queries``; the pipeline is ``corpus_pipeline.py`` at the repository top.
"""
