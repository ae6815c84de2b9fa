"""Column expressions: text, money, calendar, URLs and labels."""
