"""Column expressions: text helpers, username rules, display and validation."""
