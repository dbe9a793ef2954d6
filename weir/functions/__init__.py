"""Column functions over headers, request and response bodies."""
