"""End-to-end plans and the derivations used to check them."""
