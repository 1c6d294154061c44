"""tallyforge: a ledger analytics engine written as Spark DataFrame plans."""
