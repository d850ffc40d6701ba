"""Analytics over archives of AI-assisted work, as DataFrame to DataFrame functions."""
