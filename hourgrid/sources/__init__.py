"""Readers for landed inputs and bindings of the test tables."""
