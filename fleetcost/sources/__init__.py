"""Readers, derived inputs and sinks."""
