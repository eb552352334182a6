"""Operators of a training-data pipeline: licences, tokens, near and exact copies, HTML, packing, language, search, quality.

Nothing outside this subpackage imports it. Each module holds one operator with its own general interface; ``queries``
registers the thin driver queries.
"""
