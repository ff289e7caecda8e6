"""Column functions and the literals they need."""
