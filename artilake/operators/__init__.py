"""artilake operators."""
