"""Column functions: normal forms, tokens, similarity, features; Arrow wrappers of the kernels."""
