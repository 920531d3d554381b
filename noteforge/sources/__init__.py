"""Where rows come from: the vault data source, table adapters and reports."""
