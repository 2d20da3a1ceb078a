"""Operators for large training corpora.

Nothing outside this folder imports it; the driver contract adds its queries only when the
folder is present.  Each module holds one operator; :mod:`footing.llm.queries` holds the
thin contract queries.
"""
