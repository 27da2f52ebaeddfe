"""DataFrame-to-DataFrame operators over flow, graph and score tables."""
