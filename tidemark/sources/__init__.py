"""Tables in and out: ticks, bars, manifests."""
