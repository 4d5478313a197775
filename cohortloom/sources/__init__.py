"""Readers and writers for tables, probe sheets, matrices and region files."""
