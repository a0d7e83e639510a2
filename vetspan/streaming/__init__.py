"""State folded from streams."""
