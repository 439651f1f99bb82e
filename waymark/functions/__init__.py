"""Column expressions: Markdown, paths and routes, text scores."""
