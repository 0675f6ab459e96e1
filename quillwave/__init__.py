"""quillwave: marked-up scripts and sampled series as Spark tables."""
