"""User-level jobs composed of operators."""
