"""Training-data operators: deduplication, tokenisation, formatting, mixing,
scanning, ranking, quality rules and de-identification of text tables."""
