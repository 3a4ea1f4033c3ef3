"""Readers and writers: price files, legacy archives, provider pages, demo data."""
