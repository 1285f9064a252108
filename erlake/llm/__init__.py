"""Operators for training-data pipelines: each module holds one operator, its thin ``opN_`` query and its tests' reference semantics.

Nothing outside this package imports it; ``erlake.llm.queries`` lists its queries.
"""
