"""Sources: stored tables with declared schemas, test fixtures, price pages."""
