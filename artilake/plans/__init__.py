"""artilake plans."""
