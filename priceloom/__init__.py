"""Price-history analytics on Spark: DataFrame-to-DataFrame operators over offers, catalogs, price series and votes."""
