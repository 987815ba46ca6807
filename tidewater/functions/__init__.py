"""Column functions: typed results, parsing, time rules, text normalisation."""
