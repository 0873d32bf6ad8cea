"""Column functions and plan helpers shared by the operators."""
