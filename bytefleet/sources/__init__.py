"""Readers that turn opaque containers into relations."""
