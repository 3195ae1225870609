"""Query builders and the registered queries."""
