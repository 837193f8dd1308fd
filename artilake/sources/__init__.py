"""artilake sources."""
