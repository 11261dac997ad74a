"""Readers and writers: raw files, versioned tables, listings and literal rows."""
