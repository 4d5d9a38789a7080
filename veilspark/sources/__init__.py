"""Readers, the rule catalogue and writers."""
