"""Tables, snapshots, and pages from the network."""
