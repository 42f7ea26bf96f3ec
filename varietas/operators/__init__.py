"""DataFrame operators: diversity, filters, differential statistics, interaction models."""
