"""Operators of a training-data pipeline: ten methods over documents and pages.

Nothing outside this subpackage imports it; ``registry`` holds its queries.
"""
