"""Part of the wovenlake analytics engine."""
