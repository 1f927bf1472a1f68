"""Inputs and outputs: views over the test tables, generators, filings, caches and stores."""
