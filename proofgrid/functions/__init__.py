"""Column functions: keys, answer normalisation, tokens, stems."""
