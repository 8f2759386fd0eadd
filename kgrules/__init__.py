"""Horn-rule evaluation over knowledge graphs, as DataFrame plans."""
