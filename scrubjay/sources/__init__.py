"""Where rows come from and where bytes go."""
