"""Loan-book to credit-bureau submission files, as Spark jobs over batches of submissions."""
