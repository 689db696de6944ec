"""Readers and writers of audit inputs and results."""
