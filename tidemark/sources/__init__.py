"""Where rows come from and go to: tables, directory trees, documents, endpoints."""
