"""Action plans as rows, and the explicit step that applies them."""
