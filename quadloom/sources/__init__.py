"""Where features, tiles and changes come from and go to."""
