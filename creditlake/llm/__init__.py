"""Training-data operators: packing, near-duplicates, classifiers, scans, archives.

Nothing else in the library imports this subpackage.
"""
