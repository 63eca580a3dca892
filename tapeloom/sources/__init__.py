"""Readers, feed shaping and the bar store."""
