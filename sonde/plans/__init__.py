"""Plans composed of the operators: the code index and sessions."""
