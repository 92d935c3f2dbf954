"""The stateful operators on unbounded streams."""
