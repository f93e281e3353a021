"""Training-data operators (deduplication, language, privacy, mixing, tokens, web archives)."""
