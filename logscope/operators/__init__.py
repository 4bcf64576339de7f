"""DataFrame operators: predicates, facets, series, pivots, maps, order, export."""
