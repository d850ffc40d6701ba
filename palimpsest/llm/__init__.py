"""Training-data operators: similarity joins, fingerprints, classifiers, packing and deduplication.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; the thin queries over the standard tables are in
``palimpsest.llm.queries``.
"""
