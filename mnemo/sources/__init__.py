"""Where tables, events, vectors and mirror files come from and go to."""
