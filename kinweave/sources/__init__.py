"""Readers, catalogue scans and sinks."""
