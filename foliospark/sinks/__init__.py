"""Writers of reports, notes, slides and packages."""
