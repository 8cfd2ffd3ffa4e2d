"""Readers and writers of broadcast files."""
