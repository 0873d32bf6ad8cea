"""Streams of imported records. An extra: the indicators themselves are batch operators."""
