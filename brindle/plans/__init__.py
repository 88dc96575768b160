"""Query catalog: the operators applied to the test tables, with their SQL twins."""
