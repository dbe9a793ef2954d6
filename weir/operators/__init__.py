"""DataFrame operators over spans, traces, exchanges and metric rollups."""
