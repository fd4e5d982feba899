"""Inputs: raw change records, envelopes, source tables, files and generated changes."""
