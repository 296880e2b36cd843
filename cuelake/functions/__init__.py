"""Column functions over times and texts."""
