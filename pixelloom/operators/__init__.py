"""Operators on P-form images (one row for each pixel) and on tile plans."""
