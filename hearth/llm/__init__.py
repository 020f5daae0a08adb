"""Training-data operators: ten DataFrame operators for a text corpus.

Nothing else in the library imports this package.  ``queries.py`` registers
one query per operator; ``corpus_pipeline.py`` at the top of the repository
chains five of them.
"""
