"""Training-data operators over a table of documents.

Nothing else in the library imports this package; the queries built from it
are registered through :mod:`pointmill.llm.queries`.
"""
