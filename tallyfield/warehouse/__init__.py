"""The warehouse layer: typed tables with two time axes, and the views and audits over them."""
