"""Column expressions: text, grading and display functions. No Python runs per row."""
