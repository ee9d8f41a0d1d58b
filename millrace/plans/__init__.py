"""From text to plans: the filter language and the read-only SQL gate."""
