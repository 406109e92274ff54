"""Column functions: identifier and path text, vectors, WordPiece."""
