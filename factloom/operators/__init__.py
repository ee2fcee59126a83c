"""The relational operators of indexing and retrieval."""
