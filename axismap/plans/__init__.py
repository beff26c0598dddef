"""The map object, its builder, and the registered queries."""
