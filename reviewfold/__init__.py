"""Labelled-text and group-rate analytics written against the DataFrame API."""
