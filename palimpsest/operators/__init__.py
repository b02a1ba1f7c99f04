"""DataFrame operators over records, edges, vectors and ranked lists."""
