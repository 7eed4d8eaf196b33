"""Training-data operators: language ID, chat formatting, top-k search, packing, dedup, quality, secrets, URLs, BPE.

Nothing else in the library imports this subpackage.
"""
