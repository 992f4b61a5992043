"""Operators of a large-scale training-data pipeline (text, pages, conversations).

Nothing outside this subpackage imports it; its queries are added to the
registered ones only where it can be imported.
"""
