"""Column functions over DNA text, match summaries and alignment descriptions."""
