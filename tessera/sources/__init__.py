"""Readers: files, REST services and user-defined sources."""
