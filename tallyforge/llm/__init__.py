"""Operators for corpora of documents; nothing else in the library imports this subpackage."""
