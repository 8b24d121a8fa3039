"""Operators for cleaning the texts of forms at the scale of a training corpus. Nothing else in the library uses them."""
