"""Column helpers and the fixed values the operators share."""
