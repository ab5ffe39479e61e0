"""Column functions: text, dates, URLs, JSON, redaction."""
