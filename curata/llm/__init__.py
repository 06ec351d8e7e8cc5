"""Training-data operators: token counts, sharding, near-duplicate joins,
personal data, language, fingerprints, quality, decontamination, secrets and
packing.  Nothing outside this subpackage imports it."""
