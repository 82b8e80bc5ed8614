"""Session access, shared work folders and partition spreading."""
