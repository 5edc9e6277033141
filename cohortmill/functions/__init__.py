"""Column expressions: missing-value rules, text cleaning, recoding, bands, arrays."""
