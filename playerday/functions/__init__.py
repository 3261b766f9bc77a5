"""Column functions and statistics that scale."""
