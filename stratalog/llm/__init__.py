"""Training-data operators: ten dealt components and the queries that apply them.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin ``opN_*`` queries; every
operator module keeps a general interface of its own.
"""
