"""Values over positioned frames, and the verbs on them."""
