"""Models and queries: clock, quality, costs, features, structure, strategy, simulation, research."""
