"""Column functions: text, URL and rule-matching expressions."""
