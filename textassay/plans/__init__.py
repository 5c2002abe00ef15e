"""Model pipelines, experiments and the registered queries."""
