"""Training-data operators: filters, de-duplication, tokenizing, packing.

Self-contained: nothing outside this subpackage imports it.
"""
