"""Readers, writers, generated calendars and the shared work folder."""
