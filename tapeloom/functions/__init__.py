"""Column functions: rolling, recursive and scalar."""
