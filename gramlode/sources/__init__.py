"""Readers and writers: sequences, k-mer lists, filters, topologies, results and logs."""
