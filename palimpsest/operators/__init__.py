"""DataFrame operators: geometry, bands, chunks, tokens, matching, segmentation, graph, context, review."""
