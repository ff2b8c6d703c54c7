"""tablescout: dataset discovery on Spark.

Ranks the datasets of a collection by how often the words of a query occur in
their content or in their metadata, with DataFrame built-ins only.
"""
