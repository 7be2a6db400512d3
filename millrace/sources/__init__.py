"""Readers and writers around files, landed responses, artifacts and tables."""
