"""Readers: raw lines, transport chunks, cursors and the partitioned archive."""
