"""Training-data operators on Spark: quality rules, near-duplicates, fingerprints,
secrets, archives, licences, language models, substring duplicates, packing and
subword encoding. Nothing outside this subpackage imports it."""
