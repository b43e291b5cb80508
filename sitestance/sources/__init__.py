"""Scans: path lists, web archives, label tables, the crawl registry."""
