"""Training-data operators: packing, quality, near-duplicates, top-k search,
toxicity, secrets, HTML text, language and byte-level BPE.

Nothing else in the library imports this subpackage.
"""
