"""Where rows come from: tables, captured packets and the bridge from the given tables to traffic."""
