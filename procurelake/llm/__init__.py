"""Training-data operators: tokenising, near-duplicates, packing, scans, filters and classifiers."""
