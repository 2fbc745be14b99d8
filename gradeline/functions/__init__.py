"""Column functions: cleaning, casts, probability maths, text and seeded draws."""
