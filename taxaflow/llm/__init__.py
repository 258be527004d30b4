"""Operators for large text corpora: tokens, quality, languages, duplicates, leaks, secrets, licences."""
