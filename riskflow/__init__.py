"""Risk analytics over payment ledgers as Spark DataFrames: features, anomaly layers, fusion, a knowledge base of
parties, and review payloads.  Every function takes and returns DataFrames; only stores and reports act."""
