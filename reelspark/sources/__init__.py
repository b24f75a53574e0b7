"""Readers and writers for manifests, mappings, text artifacts, submissions and media."""
