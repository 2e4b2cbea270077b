"""PDF files as relational tables."""
