"""Training-data operators: ten document operators and the corpus pipeline built from them.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; ``queries.py`` registers the thin contract queries.
"""
