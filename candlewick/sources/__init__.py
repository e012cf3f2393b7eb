"""Reading market tables and writing them back."""
