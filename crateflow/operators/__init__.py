"""DataFrame operators: catalogue, derivations, similarity, flatten, graph."""
