"""Where rows come from and go to: stored pages, hits, robots files, PDFs, caches, status logs."""
