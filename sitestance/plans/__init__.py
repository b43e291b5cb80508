"""Whole flows, the derived demonstration corpora and the query catalogue."""
