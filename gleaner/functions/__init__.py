"""Part of the gleaner engine."""
