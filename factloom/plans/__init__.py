"""plans of factloom."""
