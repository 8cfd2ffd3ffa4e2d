"""Column functions of the broadcast operators."""
