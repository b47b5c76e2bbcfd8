"""Tables in and out: pages, node tables, articles, site rules, stage dumps."""
