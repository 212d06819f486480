"""Grid metadata, shared tables and graph fixpoints."""
