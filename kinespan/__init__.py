"""kinespan: comparison of motion sequences and the data work around it, on Spark."""
