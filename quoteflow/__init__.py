"""Price-bar, signal and ledger analytics as lazy PySpark DataFrame operators."""
