"""Table views, registered queries, their SQL, configuration and the dataset builder."""
