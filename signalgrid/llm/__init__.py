"""Training-data operators: extraction, filtering, de-duplication, scoring, formatting, encoding."""
