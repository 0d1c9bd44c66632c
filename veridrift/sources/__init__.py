"""Readers and writers of notes, records, cases and logs."""
