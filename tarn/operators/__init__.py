"""Operators on documents, chunks, postings, vectors and ranked lists."""
