"""Training-data operators (see README). Nothing outside this subpackage imports it."""
