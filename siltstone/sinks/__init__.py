"""Pages and checks made from the catalog."""
