"""Readers, writers and the model provider."""
