"""Streams of arriving records into tables that batch queries read."""
