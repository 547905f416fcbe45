"""Training-data operators: scoring, licences, dedup, language, neighbours,
packing, pieces, URLs, toxicity, fingerprints.  Nothing outside imports this."""
