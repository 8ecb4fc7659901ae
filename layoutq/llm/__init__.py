"""Training-data operators: quality rules, near-duplicate removal, redaction, mixing, packing and token files.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` are what the driver contract reads.
"""
