"""Physical layout helpers shared by the operators: hot groups, ordered scans, durable cuts."""
