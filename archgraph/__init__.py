"""archgraph: structural analysis of source repositories as Spark jobs."""
