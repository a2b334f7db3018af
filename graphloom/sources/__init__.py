"""Source readers: Java files, forms, route files."""
