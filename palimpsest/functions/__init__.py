"""Column functions: text, fuzzy similarity, syllables."""
