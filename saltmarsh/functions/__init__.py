"""Column functions: money, places, identifiers, classes of text."""
