"""Training-data operators: search, deduplication, decontamination, classifiers, scans and packing.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
