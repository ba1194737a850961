"""What a user declares: tables with typed columns, filters, cleaning recipes, sessions, exported code."""
