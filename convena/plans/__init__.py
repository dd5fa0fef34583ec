"""Plans: whole jobs made of operators, and the registry of queries over the supplied tables."""
