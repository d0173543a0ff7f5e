"""Training-data operators: deduplication, packing, archives, scoring, redaction and ledgers."""
