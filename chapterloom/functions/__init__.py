"""Column builders: pure expressions, planned and compiled by Catalyst."""
