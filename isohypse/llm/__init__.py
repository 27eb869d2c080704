"""Training-data operators on text and embedding tables.

Nothing outside this subpackage imports it; `queries` has the registered queries.
"""
