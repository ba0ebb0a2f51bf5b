"""DataFrame-to-DataFrame operators; all samples and chromosomes are handled in one plan."""
