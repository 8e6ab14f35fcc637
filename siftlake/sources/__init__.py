"""Where rows come from: files, partitions, pools, keys."""
