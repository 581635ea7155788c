"""The expression language: source text to tokens, to a tree, to plans."""
