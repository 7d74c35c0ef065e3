"""Operators for preparing text corpora: near and substring duplicates, mixing, encoding,
packing, fingerprints, secrets, nearest neighbours, language identification, sharding.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames.
"""
