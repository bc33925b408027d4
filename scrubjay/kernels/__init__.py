"""Byte-level format parsers, plain functions that Arrow batches are run through."""
