"""Tables on disk: source files, the chunk store, the manifest and the run log."""
