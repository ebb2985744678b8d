"""Training-data operators: counting, packing, storing, scanning, extracting, filtering and deduplicating text.

Nothing else in the library imports this subpackage.
"""
