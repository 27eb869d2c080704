"""Scans: files of the map formats, and relations derived from the star-schema tables."""
