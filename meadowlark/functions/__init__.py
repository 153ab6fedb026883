"""Column builders: text repair, number parsing, row patterns and title rules."""
