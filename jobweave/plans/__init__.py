"""The three flows from raw postings to result tables."""
