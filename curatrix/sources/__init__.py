"""Readers, API-dump normalisers and sinks."""
