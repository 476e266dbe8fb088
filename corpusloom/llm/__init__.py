"""Training-data operators over texts: clustering, truncation, language, pair
defects, leak-free splits, packing, benchmark leakage and sentence units.

Nothing outside this subpackage imports it.
"""
