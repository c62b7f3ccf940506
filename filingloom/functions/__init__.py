"""Column functions: text cleaning and vector arithmetic, built-ins only."""
