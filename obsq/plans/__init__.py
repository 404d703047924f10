"""Configuration text, and its compilation to plans."""
