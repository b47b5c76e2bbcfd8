"""Event streams. Every operator takes a batch or a streaming DataFrame unless it says otherwise."""
