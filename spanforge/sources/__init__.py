"""Readers, writers and role binding."""
