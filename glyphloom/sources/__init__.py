"""Corpus scans, written tables and report sinks."""
