"""Readers, writers and the table conventions of the library."""
