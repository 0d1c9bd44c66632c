"""Column functions: text, medication, uncertainty, entropy and risk rules."""
