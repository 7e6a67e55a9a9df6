"""Ready-made queries over the star-schema tables."""
