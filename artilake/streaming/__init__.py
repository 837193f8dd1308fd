"""artilake streaming."""
