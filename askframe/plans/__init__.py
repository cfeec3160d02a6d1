"""From expressions and picks to plans."""
