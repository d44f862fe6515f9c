"""Column functions: keys, texts, citations, dates, vectors."""
