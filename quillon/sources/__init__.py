"""Readers and writers of key spaces and documents."""
