"""Column expressions: tokens, masks, check digits, text spans."""
