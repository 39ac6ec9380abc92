"""Training-data operators: dedup, quality, licences, secrets, mixing, packing, search, language models."""
