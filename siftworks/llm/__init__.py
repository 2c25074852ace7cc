"""Training-data operators on Spark: filters, deduplication, tokens, scores, search and chat."""
