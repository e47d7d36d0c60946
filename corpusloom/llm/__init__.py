"""Training-data operators: filtering, near-duplicates, classification, mixing, tokenising and formatting.

Nothing outside this subpackage imports it; ``corpusloom.llm.queries`` holds the queries that apply each
operator to its whole table.
"""
