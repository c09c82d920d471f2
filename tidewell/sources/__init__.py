"""Readers: driver tables, folders of files, governed views."""
