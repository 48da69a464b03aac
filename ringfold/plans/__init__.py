"""Collections, summation, lookups, and the queries made of them."""
