"""Column functions and Arrow functions on notes, names, tags and paths."""
