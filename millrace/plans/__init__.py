"""Plan-level building blocks: durable cut points, ordered layouts, exact percentiles, reachability."""
