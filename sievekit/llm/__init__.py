"""Training-data pipeline operators (deduplication, filtering, packing, ...).

Nothing else in the library imports this subpackage.
"""
