"""Plan choices and the registered queries."""
