"""Training-data operators: mixing, pseudonyms, search, quality, dedup, tokens, secrets, licences, pages."""
