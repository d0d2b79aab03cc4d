"""Jobs that connect operators: from landed tables to commits."""
