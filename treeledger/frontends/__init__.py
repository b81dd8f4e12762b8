"""Frontends: source text to rows of syntax facts."""
