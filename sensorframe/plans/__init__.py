"""Plan shapes shared by the operators: chunked scans, runs, sized joins."""
