"""Detection rules: a YAML language whose conditions become DataFrame plans."""
