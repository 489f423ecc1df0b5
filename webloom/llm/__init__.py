"""Training-data operators: quality, sharding, extraction, decontamination, language, repeats, PII, joins, mixing."""
