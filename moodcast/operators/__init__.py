"""DataFrame -> DataFrame operators (the engine's public surface)."""
