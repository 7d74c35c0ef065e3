"""Column helpers (text, time, arrays) and exact distributed statistics."""
