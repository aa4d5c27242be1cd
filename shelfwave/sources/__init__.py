"""Readers, table schemas, the dictionary, sinks and the adapters of the sample star schema."""
