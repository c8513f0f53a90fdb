"""Plan shapes shared by the operators: bounded groups, top-k, pair blocks."""
