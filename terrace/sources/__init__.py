"""Readers with explicit schemas and writers that lay tables out for later scans and joins."""
