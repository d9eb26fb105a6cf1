"""Data model, readers and writers."""
