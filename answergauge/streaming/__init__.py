"""Streams of rounds."""
