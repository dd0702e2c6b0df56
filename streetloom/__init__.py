"""streetloom: street networks from line, point and tag tables, as Spark plans."""
