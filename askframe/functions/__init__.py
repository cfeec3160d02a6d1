"""Values of the language, and its functions."""
