"""hopvec: node embeddings (FastRP), PageRank, vector statistics, cosine k-NN / LSH and
classification metrics on Spark DataFrames.

Modules: ``functions`` (column helpers: vectors, seeds), ``operators`` (graph, fastrp,
pagerank, stats, knn, metrics, ml, vector_tables, ordered), ``sources`` (file readers and
writers), ``plans`` (fixtures over the driver tables, registered queries, SQL oracle,
end-to-end pipelines).
"""

__version__ = "0.1.0"
