"""artilake: artifacts and text corpora as Spark tables."""
