"""artilake functions."""
