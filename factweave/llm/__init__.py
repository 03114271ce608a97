"""Training-data operators: near-duplicates, mixing, secrets, scoring, decontamination,
sharding, personal data, substring dedup, quality rules, URL reputation, spelling variants, dataset manifest and line dedup."""
