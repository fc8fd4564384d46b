"""Programs of operators, rules, the query language and the index."""
