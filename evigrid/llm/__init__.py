"""Training-data operators: extraction, deduplication, scoring, scanning and tokenisation of text tables."""
