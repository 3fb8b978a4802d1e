"""Training-data operators: packing, chat formatting, similarity joins, language ID, filters, scans and deduplication."""
