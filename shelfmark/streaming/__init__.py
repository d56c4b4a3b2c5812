"""Streaming forms of the log folds, and windowed counts with late data."""
