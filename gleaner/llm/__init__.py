"""Training-data operators. Nothing else in gleaner imports this subpackage."""
