"""Training-data operators: deduplication, tokens, packing, scans, language and HTML.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
