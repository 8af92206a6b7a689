"""Binned contact maps and interval tracks on Spark: signals, domain callers, consensus, comparison, enrichment."""
