"""Column-level building blocks: rules, span algebra, tokens, text helpers."""
