"""Streams of query points: there is no operator of this kind to match, so this holds one composition only."""
