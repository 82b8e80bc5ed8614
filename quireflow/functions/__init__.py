"""Column functions on text, ids and labels."""
