"""Training-data operators: scoring, deduplication, language, decontamination, tokens, archives."""
