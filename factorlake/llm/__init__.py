"""Training-data operators: dedup, media, tokens, search, scoring, mixing and licence scans."""
