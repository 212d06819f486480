"""Training-data operators: tokenizing, filtering, deduplication, search and archives.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; :mod:`talweg.llm.queries` holds the thin
queries over the test tables.
"""
