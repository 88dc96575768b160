"""Domain operators: lazy DataFrame to DataFrame functions with frozen configurations."""
