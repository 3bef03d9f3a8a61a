"""Where vector points go."""
