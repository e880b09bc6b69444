"""Column expressions. Every function takes and returns ``Column``; none is a UDF."""
