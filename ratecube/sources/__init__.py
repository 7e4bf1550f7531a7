"""Readers and writers: fixed-width records, survey microdata, result tables."""
