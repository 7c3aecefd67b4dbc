"""Training-data operators: deduplication, cleaning, tokenisation, filtering and scoring of text corpora.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface;
``queries`` applies them to the intended tables with production parameters.
"""
