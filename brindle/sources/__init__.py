"""Readers, writers and admission checks."""
