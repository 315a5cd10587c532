"""Column functions: text normalisation, tokens, tags and lemmas."""
