"""Training-data operators: URL filters, mixing, nearest neighbours, licence scans, tokenising, deduplication, sharding, classifiers."""
