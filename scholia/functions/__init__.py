"""Column functions: text, identifiers, extraction, scores, fuzzy scorers."""
