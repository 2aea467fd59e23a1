"""Training-data operators: sharding, license scans, chat formatting, near
duplicates, quality rules, packing, decontamination, toxicity, line
de-duplication and token files.

Every module states in its docstring how it scales, and what it returns for
null, empty, repeated and very long input.
"""
