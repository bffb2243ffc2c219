"""Report operators: DataFrame in, lazy DataFrame out."""
