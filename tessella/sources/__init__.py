"""Where tables come from and go to: the snapshot log, files and manifests."""
