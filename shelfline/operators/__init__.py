"""DataFrame -> DataFrame operators over the daily table and the product profile."""
