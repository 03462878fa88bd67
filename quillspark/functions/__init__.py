"""Column functions: text, names, cryptography, policies and clocks."""
