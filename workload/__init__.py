"""The registered queries and their reference SQL over the given tables."""
