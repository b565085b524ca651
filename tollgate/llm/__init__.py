"""Training-data operators: search, filters, classifiers, near-duplicate removal, mixing and packing.

Nothing outside this package imports it; ``tollgate.llm.queries`` registers its queries.
"""
