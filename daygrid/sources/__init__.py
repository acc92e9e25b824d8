"""Readers, sinks and the mapping of the sample tables onto the data model."""
