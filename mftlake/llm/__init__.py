"""Training-data operators: deduplication, decontamination, filters, formatting, tokens and scores."""
