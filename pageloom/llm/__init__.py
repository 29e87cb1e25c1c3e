"""Training-corpus operators: deduplication, filtering, tagging, search and tokenisation."""
