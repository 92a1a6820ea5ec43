"""Operators of a training-data pipeline: fingerprints, sharding, dedup, mixing, packing and output.

Nothing outside this package imports it.  Every operator takes the columns that it names,
ignores all others, and treats null text as empty text unless its docstring says otherwise.
"""
